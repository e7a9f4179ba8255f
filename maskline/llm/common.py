"""What the operators of this subpackage share: work tables, input columns, word splitting and hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.functions.groups import each_group
from maskline.plans.session import ship
from maskline.sources.tables import discard, stored, work_path

__all__ = ["discard", "each_group", "stored", "work_path"]

#: Ids of documents that may be sent to all tasks (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Stands for a null doc_id where rows are told by doc_id and text: they come last.
LAST_ID = (1 << 63) - 1


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone, so that other columns, whatever their names, can't clash with an operator's own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def as_bytes(df: DataFrame) -> DataFrame:
    """text as its UTF-8 bytes (null: empty), for the tasks that work on bytes."""
    ship(df.sparkSession)
    return df.withColumn("text", F.coalesce(F.col("text"), F.lit("")).cast("binary"))


class Recent(dict):
    """A bounded cache: what hasn't been used while half a cache of new keys came is forgotten."""

    #: Entries of a worker process's cache: bounds its memory, not a result.
    size = 200_000

    def __init__(self) -> None:
        self.old: dict = {}

    def make(self, key: bytes):
        raise NotImplementedError

    def keep(self, key: bytes, value) -> None:
        if len(self) >= self.size // 2:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def __missing__(self, key: bytes):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.keep(key, value)
        return value


class WordHashes(Recent):
    """word -> 64-bit hash."""

    def make(self, key: bytes) -> int:
        return xxhash.xxh3_64_intdigest(key)


_caches: dict = {}


def cached(kind: type, *args):
    """A worker process's cache: it outlives the task, until a task needs one of another kind."""
    if (key := (kind, *args)) not in _caches:
        _caches.clear()
        _caches[key] = kind(*args)
    return _caches[key]


def tidy() -> None:
    """Gives back what a worker process has freed but still holds; for the end of a task, as workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it decides by itself
        pass


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that every bit depends on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k consecutive word hashes, in order; none if there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mixed(out)


def word_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def chunks(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts, from and up to, of about so many bytes together and at most 2^14; a longer text stands alone."""
    lo, held = 0, 0
    for hi, t in enumerate(texts):
        held += len(t) + 1
        if held >= size or hi - lo == (1 << 14) - 1:
            yield lo, hi + 1
            lo, held = hi + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def keyed(docs: DataFrame) -> DataFrame:
    """its_doc, text_hash and whole (the row)."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("its_doc"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose its_doc and text_hash aren't among the keys; the keys go to all tasks only if they are few."""
    keys = stored(keys, "dropped")
    few = keys.count() <= BROADCAST_IDS
    return keyed(docs).join(F.broadcast(keys) if few else keys, ["its_doc", "text_hash"], "left_anti").select("whole.*")
