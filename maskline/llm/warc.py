"""Zstandard WARC archives: one frame a record, under a dictionary that leads the file in a skippable frame.

An archive (`.warc.zst`) is: a skippable frame (magic 0x184D2A5D) with the dictionary, itself compressed or not; then one frame for
each record; skippable frames elsewhere mean nothing. Archives are written by Spark's own writer, so they land in whatever store the
path names, under its commit protocol; readers get them as files' content and need no local folder.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.plans.session import ship

from .common import stored, tidy, work_path

#: Fixed values of the formats: magic numbers of frames, and of a dictionary.
FRAME, SKIPPABLE, DICTIONARY_FRAME, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D, 0xEC30A437
#: An empty skippable frame: nothing to a reader. Its last byte is 0, which Spark's text writer supplies as its row separator.
EMPTY = struct.pack("<II", SKIPPABLE, 0)
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of at least so many bytes are written once.
LEAST_REVISIT = 100
#: Compressed bytes of a row handed to the writer, and rows of an archive: it so has about 16 MB. At many TB take 1024 rows.
ROW_BYTES, ROWS_AN_ARCHIVE = 512 << 10, 32
#: The dictionary's bytes, and the pages it is fitted on: so many about, of at most so many bytes each. It changes the size of
#: archives alone.
DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_BYTES = 64 << 10, 256, 128 << 10
#: Groups of copies whose responses may be sent to all tasks (about 80 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 200_000


# --- writing ---


def fitted_dictionary(pages: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary fitted on a bounded sample of html; empty if there is too little to fit on.

    Rows are sampled by a threshold on their hashes, so that about SAMPLE_ROWS of them reach the driver from all tasks together."""
    sound = pages.select("page_id", "html").filter(F.octet_length("html").between(1, SAMPLE_BYTES))
    many = sound.count()
    least = -(1 << 63) + int((1 << 64) * min(1.0, SAMPLE_ROWS / max(many, 1))) - 1
    texts = [r[0].encode() for r in sound.filter(F.xxhash64("page_id", "html") <= least).select("html").limit(SAMPLE_ROWS).collect()]
    if sum(map(len, texts)) < 4 * size:
        return b""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:  # too few different ones
        return b""


def record_id(page_id: int | None, digest: str) -> str:
    """The same for rows of the same page and payload."""
    return f"urn:uuid:{uuid.UUID(bytes=sha256(f'{page_id}:{digest}'.encode()).digest()[:16], version=4)}"


def record(kind: str, fields: list[tuple[str, str | None]], block: bytes, date: str) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Date", date), *fields, ("WARC-Block-Digest", f"sha256:{sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """A response, or a revisit of the page `first`: then without the payload, whose length its HTTP header still tells."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else f"urn:page:{page_id}"
    fields = [("WARC-Record-ID", f"<{record_id(page_id, digest)}>"), ("WARC-Target-URI", target), ("WARC-Page-ID", None if page_id is None else str(page_id)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if first is None:
        return record("response", fields, http + payload, date)
    return record("revisit", [*fields, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{record_id(first, digest)}>")], http, date)


def first_of_copies(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """digest, first: the smallest page_id of each payload of at least `least` bytes that more than one page has."""
    rows = pages.select("page_id", payload().alias("html")).filter(F.octet_length("html") >= least)
    groups = rows.groupBy(F.sha2("html", 256).alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    return groups.filter("n > 1 and first is not null").select("digest", "first")


def payload():
    return F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")


def write(pages: DataFrame, path: str, least: int = LEAST_REVISIT, date: str = "1970-01-01T00:00:00Z", rows: int = ROWS_AN_ARCHIVE) -> None:
    """A record for every row of pages (page_id, url, html) as archives under path.

    Null html: an empty payload. Null url: `urn:page:<id>`. Of equal payloads of at least `least` bytes the smallest page_id is the
    response; rows that repeat that id are responses too, null ids revisit it. Responses aren't moved: the scan that writes learns by a
    join with the groups of copies alone which rows are revisits; a shuffle moves the pages only where the groups are too many to send."""
    ship(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    fitted, firsts = fitted_dictionary(pages), stored(first_of_copies(pages, least), "copies")
    few = firsts.count() <= BROADCAST_GROUPS
    whole = pages.select("page_id", "url", payload().alias("html")).withColumn("digest", F.sha2("html", 256))
    whole = whole.join(F.broadcast(firsts) if few else firsts, "digest", "left")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(fitted) if fitted else None, write_checksum=True)
        lead = struct.pack("<II", DICTIONARY_FRAME, len(fitted)) + fitted if fitted else b""
        info = packer.compress(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'warcinfo')}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", date))
        held, size, row = [lead, info], 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held) + EMPTY[:-1]], pa.binary())], ["value"])

        for b in batches:
            for page, url, html, digest, first in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "digest", "first"))):
                frame = packer.compress(page_record(page, url, html, digest, None if first == page else first, date))
                held.append(frame)
                size += len(frame)
                if size >= ROW_BYTES:
                    yield out()
                    row += 1
                    held, size = [lead, info] if row % rows == 0 else [], 0  # the writer begins a new file
        if size:
            yield out()
        tidy()

    parts = whole.mapInArrow(each, "value binary").select(F.col("value").cast("string").alias("value"))
    parts.write.options(lineSep="\0", compression="none", maxRecordsPerFile=rows).text(path)


# --- reading ---


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends, from its header and its blocks' headers; ValueError if it is cut or no frame."""
    if len(data) < at + 8:
        raise ValueError("cut frame")
    magic, size = struct.unpack_from("<II", data, at)
    if magic & ~15 == SKIPPABLE:
        end = at + 8 + size
    elif magic == FRAME:
        flags = data[at + 4]
        single = flags >> 5 & 1
        end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        last = False
        while not last:
            if len(data) < end + 3:
                raise ValueError("cut frame")
            block = int.from_bytes(data[end : end + 3], "little")
            last, kind = block & 1, block >> 1 & 3
            end += 3 + (1 if kind == 1 else block >> 3)
        end += 4 * (flags >> 2 & 1)
    else:
        raise ValueError("no frame")
    if end > len(data):
        raise ValueError("cut frame")
    return end


def dictionary_of(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame (None without one), and where the records begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_FRAME:
        return None, 0
    end = frame_end(data, 0)
    held = bytes(data[8:end])
    if held[:4] == struct.pack("<I", FRAME):
        held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
    if held[:4] != struct.pack("<I", DICTIONARY):
        raise ValueError("no dictionary in the leading frame")
    return zstandard.ZstdCompressionDict(held), end


def header_fields(head: bytes) -> dict[str, str]:
    """The fields of a header by lower-cased name; lines that begin with white space continue the one before."""
    out: dict[str, str] = {}
    for line in re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n"):
        if line:
            name, colon, value = line.partition(":")
            if not colon or not name.strip():
                raise ValueError("header line without a name")
            out[name.strip().lower()] = value.strip()
    return out


def uri(value: str | None) -> str | None:
    return value.strip("<>") if value else None


RECORD = "record_type string, record_id string, refers_to_id string, page_id long, target_uri string, payload_bytes long, payload_digest string, payload binary, problem string"
NAMES = [x.split()[0] for x in RECORD.split(", ")]


def parsed(data: bytes) -> dict:
    """A record's fields by the names of RECORD; ValueError where its headers, lengths or digests don't agree."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", first):
        raise ValueError("no WARC header")
    fields = header_fields(lines)
    if missing := [x for x in ("warc-type", "warc-record-id", "warc-date", "content-length") if x not in fields]:
        raise ValueError(f"no {missing[0]}")
    if not fields["content-length"].isdigit() or int(fields["content-length"]) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        raise ValueError("length")
    block, kind = rest[:-4], fields["warc-type"]
    if (said := fields.get("warc-block-digest", "")).startswith("sha256:") and said[7:] != sha256(block).hexdigest():
        raise ValueError("block digest")
    out = dict.fromkeys(NAMES) | {"record_type": kind, "record_id": uri(fields["warc-record-id"]), "target_uri": uri(fields.get("warc-target-uri"))}
    if (page := fields.get("warc-page-id")) is not None:
        out["page_id"] = int(page)
    if kind not in ("response", "revisit"):
        return out
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    length = header_fields(http.partition(b"\r\n")[2]).get("content-length", "")
    digest = fields.get("warc-payload-digest", "")
    if not length.isdigit() or not digest.startswith("sha256:"):
        raise ValueError("no payload length or digest")
    if kind == "response":
        if int(length) != len(payload):
            raise ValueError("payload length")
        if digest[7:] != sha256(payload).hexdigest():
            raise ValueError("payload digest")
        out["payload"] = payload
    else:
        if payload:
            raise ValueError("revisit with a payload")
        if not (refers := uri(fields.get("warc-refers-to"))):
            raise ValueError("no warc-refers-to")
        out["refers_to_id"] = refers
    return out | {"payload_bytes": int(length), "payload_digest": digest[7:]}


def records(data: memoryview) -> Iterator[dict]:
    """The records of an archive, one frame each. A record that isn't right is given with its problem; after a frame that isn't one,
    nothing tells where the next begins: that is the last one given."""
    at = 0
    try:
        dictionary, at = dictionary_of(data)
        unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
        while at < len(data):
            end = frame_end(data, at)
            if struct.unpack_from("<I", data, at)[0] == FRAME:
                try:
                    whole = unpacker.decompressobj()
                    text = whole.decompress(data[at:end])
                    if not whole.eof:
                        raise ValueError("cut frame")
                    yield parsed(text)
                except (ValueError, zstandard.ZstdError) as e:
                    yield dict.fromkeys(NAMES) | {"problem": f"byte {at}: {e}"}
            at = end
    except (ValueError, zstandard.ZstdError) as e:
        yield dict.fromkeys(NAMES) | {"problem": f"byte {at}: {e}"}


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under path, with the name of their archive: see RECORD. payloads: False leaves them null.

    A task holds one archive; problem tells what is wrong with a record, or a file from there on. An empty file has no records."""
    ship(spark)
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, name in enumerate(b["path"].to_pylist()):
                data, held, size = memoryview(b["content"][i].as_buffer()), [], 0

                def out() -> pa.RecordBatch:
                    columns = [pa.array([r[n] for r in held], kinds.get(n, pa.string())) for n in NAMES]
                    return pa.RecordBatch.from_arrays([pa.array([name] * len(held)), *columns], ["archive", *NAMES])

                for r in records(data):
                    if not payloads:
                        r["payload"] = None
                    held.append(r)
                    size += 500 + len(r["payload"] or b"")
                    if size >= 4 << 20:
                        yield out()
                        held, size = [], 0
                if held:
                    yield out()
        tidy()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(each, f"archive string, {RECORD}")


def resolved(found: DataFrame) -> DataFrame:
    """Records with refers_to, the page of the response that a revisit refers to; a revisit without one, or of another digest or
    length, has a problem.

    Responses are joined with the different ids that revisits name, one row each, however many revisits a response has; what came of
    that goes to all tasks if it was counted as few. found is read more than once: give a stored table."""
    named = found.filter("record_type = 'revisit'").select("refers_to_id").distinct()
    responses = found.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), "page_id", "payload_digest", "payload_bytes")
    to = named.join(responses, "refers_to_id").groupBy("refers_to_id").agg(F.min("page_id").alias("refers_to"), F.min("payload_digest").alias("its_digest"), F.min("payload_bytes").alias("its_bytes"))
    to = stored(to, "referred")
    to = F.broadcast(to) if to.count() <= BROADCAST_GROUPS else to
    agrees = F.col("its_digest").eqNullSafe(F.col("payload_digest")) & F.col("its_bytes").eqNullSafe(F.col("payload_bytes"))
    problem = F.coalesce("problem", F.when((F.col("record_type") == "revisit") & ~agrees, "no such response"))
    return found.join(to, "refers_to_id", "left").withColumn("problem", problem).drop("its_digest", "its_bytes")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of Zstandard WARC archives, read back: page_id, payload_bytes, payload_digest, record_type, refers_to,
    and problem (null for a sound record). See write() on nulls and repeated rows. No pages: no rows."""
    path = work_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = resolved(stored(read(spark, path, payloads=False).filter("record_type <> 'warcinfo' or problem is not null"), "records"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


OP13_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, NULL::VARCHAR AS problem FROM f
"""
