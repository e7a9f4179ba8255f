"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Two words one inserted, deleted or replaced code point apart have lengths that differ by one at most, and letter counts whose squared
distance is at most two. Blocks hold the words of two adjacent lengths that share the letters outside a window: one edit leaves
one half of a window alone, so each pair meets in the block of its left or right half, and a block over BLOCK words is split by the
halves of its window again, until the window is one letter long (then the alphabet bounds it). No pair is lost. In a block one
NumPy product of letter counts gives all squared distances; pairs at most two apart have their edits verified.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.functions.groups import each_group
from maskline.plans.session import ship

from .common import stored, tidy

RUN = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, TYPO_EVERY, FORM_FACTOR = 7, 2, 31, 10
#: Letters of a word after A-Z are lower-cased: a count for each.
LETTERS = [*map(chr, range(ord("a"), ord("z") + 1)), *map(chr, range(0xC0, 0x100))]
#: Words of a block, beyond which it is split; and words that one product takes together from small blocks.
BLOCK, TOGETHER = 2048, 384
#: Different words that a task counts before it hands them on.
HELD_WORDS = 500_000
#: Keys of blocks to split that may be sent to all tasks; more are joined by a shuffle.
BROADCAST_KEYS = 100_000
#: Sums of squared counts stay exact in 32-bit floats up to this length.
EXACT_32 = 4000

_UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(docs: DataFrame, every: int = TYPO_EVERY, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of all whole texts: runs of letters, A-Z lower-cased. Where `every` divides h, the crc32 of `<doc_id>:<run>`, the run
    loses its code point h % length. Words of at least so many code points and occurrences stay.

    Null text: no words. A null doc_id is written as nothing. Rows are counted one by one, so repeated rows count repeatedly."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = re.compile(RUN[:-1] + f"{{{min_length},}}").findall, {}

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(held)
            for lo in range(0, len(keys), 1 << 16):
                some = keys[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([held[k] for k in some], pa.int64())], ["word", "n"])
            held.clear()

        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
                mine: dict[str, int] = {}
                for run in find(text.as_py().translate(_UPPER)):
                    mine[run] = mine.get(run, 0) + 1
                start = crc32(b"%d:" % doc if doc is not None else b":")
                for run, n in mine.items():
                    h = crc32(run.encode(), start)
                    if h % every == 0:
                        k = h % len(run)
                        run = run[:k] + run[k + 1 :]
                        if len(run) < min_length:
                            continue
                    held[run] = held.get(run, 0) + n
            if len(held) >= HELD_WORDS:
                yield from out()
        yield from out()
        tidy()

    return rows.mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


KEY = ["base", "skip", "tail", "cap", "anchor"]


def first_keys(vocabulary: DataFrame) -> DataFrame:
    """base, skip, tail, cap, anchor, word, n: each word under the whole of its length's window, and of the window one shorter.

    base: length of the shorter words of a block; its words share their first `skip` and last `tail` letters (anchor). A pair counts
    in this block only if its common prefix is shorter than cap, as else a block further left has it."""
    bases = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("base")
    return vocabulary.select(bases, F.lit(0).alias("skip"), F.lit(0).alias("tail"), F.lit(1 << 30).alias("cap"), F.lit("").alias("anchor"), "word", "n")


def split_keys(rows: DataFrame) -> DataFrame:
    """Each row in the two blocks of its window's halves."""
    half = F.floor((F.col("base") - F.col("skip") - F.col("tail")) / 2).cast("int")
    left = F.struct((F.col("skip") + half).alias("skip"), F.col("tail").alias("tail"), F.col("cap").alias("cap"))
    right = F.struct(F.col("skip").alias("skip"), (F.col("base") - F.col("skip") - half).alias("tail"), (F.col("skip") + half).alias("cap"))
    rows = rows.select("base", F.explode(F.array(left, right)).alias("k"), "word", "n").select("base", "k.*", "word", "n")
    anchor = F.concat(F.substring("word", F.lit(1), F.col("skip")), F.lit("\t"), F.right("word", F.col("tail")))
    return rows.select("base", "skip", "tail", "cap", anchor.alias("anchor"), "word", "n")


def blocks(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """first_keys() with every block over `block` words split, but for windows of one letter."""
    rows, done = split_keys(first_keys(vocabulary)), None
    while True:
        rows = stored(rows, "spelling")
        large = rows.groupBy(*KEY).agg(F.count("*").alias("size")).filter((F.col("size") > block) & (F.col("base") - F.col("skip") - F.col("tail") > 1))
        large = stored(large.select(*KEY), "large")
        many = large.count()
        if not many:
            return rows if done is None else done.unionByName(rows)
        if many <= BROADCAST_KEYS:
            large = F.broadcast(large)
        fine = rows.join(large, KEY, "left_anti")
        done = fine if done is None else done.unionByName(fine)
        rows = split_keys(rows.join(large, KEY, "left_semi"))


def one_edit(a: str, b: str) -> int:
    """The common prefix's length, if b is a with one letter replaced or put in; else -1. b is as long or one longer."""
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return p if a != b and a[p + (len(a) == len(b)) :] == b[p + 1 :] else -1


def letter_counts(some: list[str], exact_64: bool) -> np.ndarray:
    out = np.zeros((len(some), len(LETTERS)), np.float64 if exact_64 else np.float32)
    codes = np.frombuffer("".join(some).encode("latin-1"), np.uint8)
    of = np.where(codes >= 0xC0, codes.astype(np.int16) - 0xC0 + 26, codes.astype(np.int16) - ord("a"))
    np.add.at(out, (np.repeat(np.arange(len(some)), [len(x) for x in some]), of), 1)
    return out


def near_in(base: np.ndarray, group: np.ndarray, some: list[str], caps: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places of the pairs one edit apart within the groups: a shorter or equally long word first. base: a word's block's base."""
    lengths = np.array([len(x) for x in some])
    short = np.flatnonzero(lengths == base)
    if not len(short):
        return
    x = letter_counts(some, bool(lengths.max() > EXACT_32))
    norms = (x * x).sum(1)
    for lo in range(0, len(short), 512):
        rows = short[lo : lo + 512]
        apart = norms[rows, None] + norms[None, :] - 2 * (x[rows] @ x.T)
        same = lengths[rows, None] == lengths[None, :]
        hit = (apart <= 2) & (group[rows, None] == group[None, :]) & ((same & (apart > 0) & (rows[:, None] < np.arange(len(some))[None, :])) | (lengths[rows, None] + 1 == lengths[None, :]))
        for i, j in zip(*np.nonzero(hit)):
            p = one_edit(some[rows[i]], some[j])
            if 0 <= p < caps[j]:
                yield int(rows[i]), int(j)


def near_pairs(keyed: DataFrame) -> DataFrame:
    """word, near, near_n: both ways of every pair of words one edit apart, once."""
    ship(keyed.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0

        def compared() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables([x for x, _ in held])
            some, n, caps = t["word"].to_pylist(), t["n"].to_numpy(), t["cap"].to_numpy()
            group = np.repeat([k for _, k in held], [len(x) for x, _ in held])
            pairs = np.array(list(near_in(t["base"].to_numpy(), group, some, caps)), np.int64).reshape(-1, 2)
            both = np.r_[pairs, pairs[:, ::-1]]
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.array([some[i] for i in both[:, 0]]), pa.array([some[i] for i in both[:, 1]]), pa.array(n[both[:, 1]])], ["word", "near", "near_n"])

        for t in each_group(batches, "block"):
            number += 1
            if len(t) < 2:
                continue
            if held and (size + len(t) > TOGETHER):
                yield from compared()
                held, size = [], 0
            held.append((t, number))
            size += len(t)
        if held:
            yield from compared()
        tidy()

    rows = keyed.withColumn("block", F.concat_ws("\t", *KEY)).select("block", "base", "cap", "word", "n")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(each, "word string, near string, near_n long")


def rooted(forms: DataFrame) -> DataFrame:
    """forms (word, form: null at an end) with root, the last word that the forms lead to. Each round doubles the steps taken.

    A form is at least ten times as frequent as its word, so chains are short; a common form's few hundred variants bound a key."""
    now = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        far = now.filter("root <> word").select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stored(now.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not after.filter("moved").limit(1).count():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(vocabulary: DataFrame, factor: int = FORM_FACTOR, block: int = BLOCK) -> DataFrame:
    """vocabulary (word, n; words differ) -> word, form, root, n, n_near, form_n.

    form: the near word of largest n (ties: the smallest), if that is at least factor times the word's n. No words: no rows."""
    vocabulary = stored(vocabulary, "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_pairs(blocks(vocabulary, block)).groupBy("word").agg(F.count("*").alias("n_near"), best)
    fits = -F.col("best.less") >= factor * F.col("n")
    rows = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    rows = stored(rows, "forms")
    return rows.join(rooted(rows), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of documents with its near words counted, the more frequent form that it is a variant of, and that chain's end."""
    return variants(words(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: h for every run of a document: bytes of '<doc_id>:<run>' through a table of 256 remainders.
OP12_SQL = r"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, _: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END) ORDER BY i) AS c FROM range(256) t(i)),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
docruns AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT id, run, n, hex(encode(id || ':' || run)) AS x FROM docruns),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, length(x) // 2), lambda i: ((strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)::UBIGINT)), lambda a, b: xor(a >> 8, c[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS h FROM bytes, crc),
t AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM t WHERE length(word) >= 7 GROUP BY ALL HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pair AS (SELECT a.word AS word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, w.word, w.n FROM cut JOIN w ON cut.rest = w.word UNION SELECT w.word, cut.word, cut.n FROM cut JOIN w ON cut.rest = w.word),
best AS (SELECT word, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM pair),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM w LEFT JOIN best ON w.word = best.word AND k = 1),
chain AS (WITH RECURSIVE c AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, c.next, f.form FROM c JOIN f ON f.word = c.next) SELECT word, root FROM c WHERE next IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN chain USING (word)
"""
