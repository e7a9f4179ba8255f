"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a run of LEAST words are joined. Each pair is tiled: the longest common runs
that do not overlap are marked again and again, found by running Karp-Rabin hashes. Tiles may come in any order, so
reordered passages count. A pair is a leak if the tiles cover at least COVERAGE of the item's words.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.plans.session import ship

from .common import WordHashes, cached, id_text, stored, tidy, windows, word_hashes

LEAST = 5
COVERAGE = 0.5
#: Bits of the filter that tasks hold against the benchmark's runs; a false hit only costs a join.
FILTER_BITS = 27
SALTS = 16
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words (letters and digits, lower case)."""
    return word_hashes(WORD.findall((text or "").lower().encode("utf-8", "replace")), cached(WordHashes))


def seed_hashes(h: np.ndarray, lengths: list[int]) -> np.ndarray:
    return np.unique(np.concatenate([windows(h, k) + np.uint64(k) for k in lengths])) if lengths else np.empty(0, np.uint64)


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of the tiles, in the order they are marked: the longest match that is free goes first; of
    equally long ones the first in doc, then in item. What a tile cuts of a match stays in the running with its free parts."""
    out, mine, its = [], np.zeros(len(item), bool), np.zeros(len(doc), bool)

    def free(marked: np.ndarray, s: int) -> np.ndarray:
        c = np.r_[0, np.cumsum(marked)]
        return np.flatnonzero(c[s:] == c[: len(c) - s])

    size = max(least, min(len(item), len(doc)))
    while True:
        a, b = free(mine, size), free(its, size)
        found, longest = defaultdict(list), 0
        if len(a) and len(b):
            ha, hb = windows(item, size)[a], windows(doc, size)[b]
            b, hb = b[at := np.isin(hb, ha)], hb[at]
            where = defaultdict(list)
            for i, h in zip(a.tolist(), ha.tolist()):
                where[h].append(i)
            for j, h in zip(b.tolist(), hb.tolist()):
                for i in where[h]:
                    if i and j and item[i - 1] == doc[j - 1] and not mine[i - 1] and not its[j - 1]:
                        continue  # a longer match starts before
                    n = size
                    while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not mine[i + n] and not its[j + n]:
                        n += 1
                    found[n].append((i, j))
                    longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        heap = [(-n, j, i) for n, places in found.items() for i, j in places]
        heapq.heapify(heap)
        while heap:
            n, j, i = heapq.heappop(heap)
            taken = np.r_[-1, np.flatnonzero(mine[i : i - n] | its[j : j - n]), -n]
            if len(taken) == 2:
                mine[i : i - n] = its[j : j - n] = True
                out.append((i, j, -n))
                continue
            for lo, hi in zip((taken[:-1] + 1).tolist(), taken[1:].tolist()):
                if hi - lo >= size:
                    heapq.heappush(heap, (lo - hi, j + lo, i + lo))
        if size == least:
            return out
        size = size // 2 if size > 2 * least else least


def item_seeds(items: DataFrame, least: int) -> DataFrame:
    """item_id, words, length (of the seed: the whole item's if it has fewer words), seed, times (that it comes in the item)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b["item_id"].to_pylist(), b["text"].to_pylist()):
                h = words_of(text)
                k = min(least, len(h))
                seeds, times = np.unique(windows(h, k) + np.uint64(k), return_counts=True) if k else (np.empty(0, np.uint64), np.empty(0, np.int64))
                same = lambda x, kind: pa.array([x] * len(seeds), kind)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([same(item, pa.int64()), same(len(h), pa.int64()), same(k, pa.int32()), pa.array(seeds.view(np.int64)), pa.array(times, pa.int64())], ["item_id", "words", "length", "seed", "times"])

    return items.mapInArrow(each, "item_id long, words long, length int, seed long, times long")


def leaks(docs: DataFrame, items: DataFrame, least: int = LEAST, coverage: float = COVERAGE, below_too: bool = False) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> doc_id, text_hash, item_id, covered, item_words, coverage, n_tiles, leak.

    A row for each pair that may be a leak; with below_too for each pair that shares a run. Tiles cover at most `length` words
    for each place of a shared seed in the item, so pairs with too few of them are left out before texts are fetched. An item of fewer than `least` words has to stand whole; one without words,
    or without an id, is in no pair. Null or empty documents are in no pair. Of equal documents each has its own rows.
    """
    spark = docs.sparkSession
    ship(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("item_id is not null").dropDuplicates()
    seeds = stored(item_seeds(items, least), "seeds")
    lengths = sorted(r["length"] for r in seeds.select("length").distinct().collect())  # at most `least` numbers
    bit = F.pmod(F.col("seed"), F.lit(1 << FILTER_BITS))
    held = seeds.groupBy(F.shiftright(bit, 3).alias("byte")).agg(F.bit_or(F.pow(F.lit(2), bit % 8).cast("long")).alias("bits")).toArrow()  # at most 2^24 rows
    table = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    table[held["byte"].to_numpy()] = held["bits"].to_numpy()
    sent = spark.sparkContext.broadcast(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            rows, found = [], []
            for i, text in enumerate(b["text"].to_pylist()):
                s = seed_hashes(words_of(text), lengths)
                at = s & np.uint64((1 << FILTER_BITS) - 1)
                s = s[table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0]
                if len(s):
                    rows.append(i)
                    found.append(s.view(np.int64))
            part = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["text"], pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text", "found"])
        tidy()

    hits = docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, text string, found array<long>")
    hits = stored(hits.withColumn("row", F.monotonically_increasing_id()), "hits")
    salted = seeds.select("item_id", "words", "length", "seed", "times", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = hits.select("row", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"), F.explode("found").alias("seed")).join(salted, ["seed", "salt"])
    pairs = pairs.groupBy("row", "item_id").agg(F.sum(F.col("times") * F.col("length")).alias("most"), F.first("words").alias("words"))
    if not below_too:
        pairs = pairs.filter(F.col("most") >= coverage * F.col("words"))
    pairs = pairs.select("row", "item_id")
    pairs = pairs.join(items.withColumnRenamed("text", "item"), "item_id").join(hits.select("row", "doc_id", "text"), "row")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            covered, sizes, counts = [], [], []
            for item, text in zip(b["item"].to_pylist(), b["text"].to_pylist()):
                a = words_of(item)
                t = tiles(a, words_of(text), min(least, len(a)))
                covered.append(sum(x[2] for x in t))
                sizes.append(len(a))
                counts.append(len(t))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], b["item_id"], pa.array(covered, pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "text_hash", "item_id", "covered", "item_words", "n_tiles"])
        tidy()

    pairs = pairs.select("doc_id", F.xxhash64("text").alias("text_hash"), "item_id", "item", "text")
    out = pairs.mapInArrow(tile, "doc_id long, text_hash long, item_id long, covered long, item_words long, n_tiles long")
    share = F.col("covered") / F.col("item_words")
    return out.select("doc_id", "text_hash", "item_id", "covered", "item_words", share.alias("coverage"), "n_tiles", (share >= coverage).alias("leak"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks of benchmark items in documents."""
    found = leaks(id_text(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter("leak").drop("text_hash", "leak")
