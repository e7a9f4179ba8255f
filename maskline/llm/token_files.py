"""Token-ID / binary output: flat unsigned integer files with 64-bit document offsets.

Layout under one folder (every file is written by Spark, so it lands in whatever store the path names, with
Spark's commit protocol against lost executors):

- ``ids/kind=tokens/part-NNNNN*``: the token ids of one range of documents, back to back, as little-endian
  unsigned integers (16 bits if the vocabulary and the end id allow it, else 32), no header;
- ``ids/kind=index/part-NNNNN*``: 24 bytes a document, as int64: doc_id, 1 if it has an id, number of ids;
- ``starts/part=N/*``: 64-bit offsets, one for each document and one past the last: ids before it, over all parts.

Parts are ranges of doc_id, so part order is id order; a part's base is the prefix sum of the parts' totals.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Recent, as_bytes, cached, chunks, id_text, tidy, work_path

END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Bytes of text a part should hold: they give about half as many bytes of ids. At many TB take 256 MB.
PART_BYTES = 8 << 20
#: Parts whose bases are summed by one task, and parts that one task reads.
PARTS_A_RUN, PARTS_A_TASK = 1024, 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: ASCII punctuation: where it ends a word, the tokenizer splits before it.
MARKS = bytes(i for i in range(33, 127) if not chr(i).isalnum())


def core_of(piece: bytes) -> bytes:
    """The piece less the ASCII punctuation at its end, if its ids are those of the two, one after the other: what stands
    before has to end in an ASCII letter or digit, or in a letter of Latin-1; else the whole piece."""
    core = piece.rstrip(MARKS)
    if len(core) == len(piece) or not core or b"<|" in piece:
        return piece
    if core[-1] < 0x80:
        return core if core[-1:].isalnum() else piece
    return core if len(core) > 1 and core[-2] == 0xC3 and core[-1] not in (0x97, 0xB7) else piece


class PieceCache(Recent):
    """White-space separated piece, A-Z lower-cased and without punctuation at its end -> its ids as bytes.

    The tokenizer lower-cases, drops white space and never joins across it: a text's ids are those of its pieces in
    order. New pieces are encoded some at a time, as one text; each id's offset tells the piece that it is of.
    """

    size = 1_000_000

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.kind = Tokenizer.from_file(path), kind

    def encoded(self, keys: list[bytes], together: int = 256) -> dict[bytes, bytes]:
        made = {}
        for lo in range(0, len(keys), together):
            part = keys[lo : lo + together]
            texts = [x.decode() for x in part]
            first = np.cumsum([0, *(len(x) + 1 for x in texts)])
            e = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids, at = np.array(e.ids, self.kind).tobytes(), [x for x, _ in e.offsets]
            cuts = (np.searchsorted(at, first) * int(self.kind[-1])).tolist()
            for i, key in enumerate(part):
                made[key] = ids[cuts[i] : cuts[i + 1]]
        return made

    def known(self, keys: set[bytes]) -> dict[bytes, bytes]:
        """The ids of some pieces. Kept for later: the newest, at most `size`."""
        found = {x: self[x] for x in keys & self.keys()}
        new = keys - found.keys()
        if self.old:
            again = {x: self.old[x] for x in new & self.old.keys()}
            found |= again
            self.update(again)
            new -= again.keys()
        made = self.encoded(list(new))
        self.update(made)
        if len(self) > self.size // 2:
            self.old = {}
            self.old = dict(self) if len(self) <= self.size else {}
            self.clear()
        return found | made

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of some texts. Give a few MB at a time: their different pieces are held."""
        pieces = [t.split() if b"<|" in t else t.lower().split() for t in texts]  # special tokens are told by their case
        cores = {p: core_of(p) for p in set().union(*pieces)}
        rests = {p: p[len(c) :] for p, c in cores.items() if len(c) < len(p)}
        ids = self.known(set(cores.values()).union(rests.values()))
        whole = {p: ids[c] for p, c in cores.items()}
        for p, rest in rests.items():
            whole[p] += ids[rest]
        return [b"".join(map(whole.__getitem__, p)) for p in pieces]


def id_kind(path: str, end_id: int) -> str:
    """'<u2' if all ids fit and the end id is below 256, else '<u4': either way a document's last byte is 0."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 and end_id < 256 else "<u4"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, part_bytes: int = PART_BYTES) -> None:
    """Encodes every whole text and writes the files of this module's format to path.

    Null or empty text: the end id alone. Null doc_id: kept, first, and marked in the index. Rows with the same
    doc_id are all kept, next to each other (ordered by their text). No documents: no parts.
    """
    spark, kind = docs.sparkSession, id_kind(tokenizer, end_id)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2, int(size // part_bytes) + 1)
    ranged = as_bytes(docs).repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    end, wide = np.array([end_id], kind).tobytes(), int(kind[-1])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache, index, row = cached(PieceCache, tokenizer, kind), [], 0

        def out(name: str, values: list[bytes], first: int) -> pa.RecordBatch:
            numbers = np.arange(first, first + len(values))
            return pa.RecordBatch.from_arrays([pa.array([name] * len(values)), pa.array(numbers), pa.array(values, pa.binary())], ["kind", "row", "value"])

        for batch in batches:
            docs, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for lo, hi in chunks(texts, 4 << 20):
                values = [ids + end for ids in cache.encode(texts[lo:hi])]
                index += [(doc or 0, int(doc is not None), len(ids) // wide) for doc, ids in zip(docs[lo:hi], values)]
                yield out("tokens", values, row)
                row += len(values)
        for lo in range(0, len(index), 4096):
            yield out("index", [np.array(x, "<i8").tobytes() for x in index[lo : lo + 4096]], lo)
        tidy()

    rows = ranged.mapInArrow(encode, "kind string, row long, value binary").sortWithinPartitions("kind", "row")
    write_flat(rows, f"{path}/ids", "kind")
    if not written(spark, f"{path}/ids/kind=index"):
        return

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, base, index in zip(b["part"].to_pylist(), b["base"].to_pylist(), b["content"].to_pylist()):
                lengths = np.frombuffer(index, "<i8").reshape(-1, 3)[:, 2]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([(base + np.r_[0, np.cumsum(lengths)]).astype("<i8").tobytes()], pa.binary())], ["part", "value"])
        tidy()

    based = files(spark, f"{path}/ids/kind=index").select("part", "content").join(part_bases(files(spark, f"{path}/ids/kind=tokens"), wide), "part")
    write_flat(based.select("part", "base", "content").mapInArrow(starts, "part int, value binary"), f"{path}/starts", "part")


def part_bases(parts: DataFrame, wide: int) -> DataFrame:
    """part, base: how many ids stand in the parts before. parts: part, length (in bytes).

    Prefix sums in two levels: within runs of PARTS_A_RUN parts, and over the runs' totals, of which there are few.
    """
    rows = parts.select("part", F.floor(F.col("part") / PARTS_A_RUN).alias("run"), (F.col("length") / wide).cast("long").alias("ids"))
    runs = rows.groupBy("run").agg(F.sum("ids").alias("total"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("run", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first"))
    before = Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    return rows.join(runs, "run").select("part", (F.col("first") + F.col("own")).alias("base"))


def write_flat(rows: DataFrame, path: str, by: str) -> None:
    """Writes the bytes of value back to back, a folder for each value of `by`.

    Spark's text writer ends each row with a separator. The last byte of every value here is 0 (see id_kind; numbers
    stay below 2^56), so each row leaves that byte to the separator: the file is the plain concatenation.
    """
    cut = F.col("value").substr(F.lit(1), F.length("value") - 1).cast("string")
    rows.select(by, cut.alias("value")).write.partitionBy(by).options(lineSep="\0", compression="none", maxRecordsPerFile=0).text(path)


def written(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def files(spark: SparkSession, path: str) -> DataFrame:
    """part, path, length, content: the flat files below path, one row each; the part number is in the file's path.
    Files are read only where content is asked for."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return read.select(F.regexp_extract("path", r"/part[-=](\d+)", 1).cast("int").alias("part"), "path", "length", "content")


ROWS = "doc_id long, part int, start long, n_tokens long, ids binary"


def local_name(path: str) -> str:
    return unquote(path.removeprefix("file:"))


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The files as rows: doc_id, part, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32 bits).

    In a folder that all machines see as files, tasks map them into memory; from any other store Spark hands over their
    content. Either way a task takes a part's ids, index and offsets together, joined by part.
    """
    if not written(spark, f"{path}/ids/kind=index"):
        return spark.createDataFrame([], ROWS)
    mapped = path.startswith(("file:", "/")) and spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"
    value = "path" if mapped else "content"
    index = files(spark, f"{path}/ids/kind=index").select("part", F.col(value).alias("index"))
    starts = files(spark, f"{path}/starts").select("part", F.col(value).alias("starts"))
    rows = files(spark, f"{path}/ids/kind=tokens").select("part", "length", F.col(value).alias("ids")).join(index, "part").join(starts, "part")
    if mapped:  # rows are names alone: deal them out evenly, some parts to a task
        rows = rows.repartition(max(1, -(-rows.count() // PARTS_A_TASK)), "part")

    def table(x: bytes | str, kind: str) -> np.ndarray:
        return np.memmap(local_name(x), kind, "r") if mapped else np.frombuffer(x, kind)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, content, index, starts in zip(*(b[k].to_pylist() for k in ("part", "ids", "index", "starts"))):
                documents, starts, ids = table(index, "<i8").reshape(-1, 3), table(starts, "<i8"), table(content, kind)
                at = starts - starts[0]
                if at[-1] != len(ids):
                    raise ValueError(f"part {part} holds {len(ids)} ids, its offsets say {at[-1]}")
                step = max(1, (1 << 20) * len(documents) // max(1, len(ids)))
                for lo in range(0, len(documents), step):
                    hi = min(lo + step, len(documents))
                    blobs = [ids[at[i] : at[i + 1]].astype("<u4").tobytes() for i in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays([pa.array(documents[lo:hi, 0], mask=documents[lo:hi, 1] == 0), pa.array([part] * (hi - lo), pa.int32()), pa.array(starts[lo:hi]), pa.array(documents[lo:hi, 2]), pa.array(blobs, pa.binary())], ["doc_id", "part", "start", "n_tokens", "ids"])
        tidy()

    return rows.select("part", "ids", "index", "starts").mapInArrow(split, ROWS)


class MappedTokens:
    """The ids of a local copy of such a folder, memory-mapped: tokens[i] are the ids of the i-th document."""

    def __init__(self, path: str, kind: str):
        def listed(top: str) -> list[str]:
            found = [os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.startswith("part-")]
            return sorted(found, key=lambda f: int(re.search(r"/part[-=](\d+)", f)[1]))

        self.ids = [np.memmap(f, kind, "r") for f in listed(f"{path}/ids/kind=tokens")]
        self.starts = [np.memmap(f, "<i8", "r") for f in listed(f"{path}/starts")]
        self.first = np.cumsum([0, *(len(s) - 1 for s in self.starts)])

    def __len__(self) -> int:
        return int(self.first[-1])

    def __getitem__(self, i: int) -> np.ndarray:
        part = int(np.searchsorted(self.first, i, "right")) - 1
        s, k = self.starts[part], i - self.first[part]
        return self.ids[part][s[k] - s[0] : s[k + 1] - s[0]]


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as ids in this format, read back: doc_id, start, n_tokens, ids_crc32. See digest()."""
    return digest(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """What the files of docs (doc_id, text) hold of each row: doc_id, start, n_tokens, ids_crc32, part.

    Null or empty text: the end id alone. Null doc_ids come first. Rows with the same doc_id stand next to each other, by
    text; equal rows each have their own ids. Other columns are left aside. No documents: no rows.
    """
    tokenizer, path = tokenizer_path(), work_path(spark, "tokens")
    write(id_text(docs), path, tokenizer)
    return read(spark, path, id_kind(tokenizer, END_ID)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "part")
