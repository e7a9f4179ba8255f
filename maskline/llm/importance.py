"""Quality classifier by importance resampling.

Two hashed n-gram generative models, of target text (labelled good) and of all raw text, give each document the
logarithm of its importance weight; documents are drawn without replacement in proportion to their weights by adding
Gumbel noise and taking the top k. Features: tokens and pairs of tokens, and likewise of their shapes (letter case,
punctuation, and whether the token stood just before), hashed to BUCKETS.

A text's weight is tempered: it counts as EVIDENCE tokens at most, as a text's tokens aren't independent of each other; so
texts of like quality have like chances, whatever their lengths, and the noise decides between them. k doesn't follow
from the weights: it is a given share of the documents, by default the share of good ones among the labelled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskline.plans.session import ship

from .common import LAST_ID, Recent, as_bytes, cached, chunks, id_text, mixed, stored, tidy, without

BUCKETS = 1 << 16
#: Labelled rows (those of the smallest hashes) that the target model and the default share are fitted on.
LABELLED = 20_000
#: Tokens that a text counts as, at most.
EVIDENCE = 30.0
#: Rows that are ranked one by one to find the k-th; an interval of values that holds more is narrowed first.
RANKED = 100_000
SEED = 7
#: Stands for a null doc_id in comparisons.
NO_ID = -(1 << 62)
#: Features seen that each bucket starts with in either model.
PRIOR = 2.0
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")


class TokenHashes(Recent):
    """token -> 64-bit hash whose low 6 bits are its shape: 0-3 word by case, 4 number, else punctuation by its first character and length."""

    def make(self, key: bytes) -> int:
        first = key[0]
        if first >= 0x80 or chr(first).isalpha():
            low, up = key.islower(), key.isupper()
            shape = 0 if low else 1 if up and len(key) > 1 else 2 if key[1:].islower() or len(key) == 1 else 3
        elif 48 <= first < 58:
            shape = 4
        else:
            shape = 5 + (first % 19) * 3 + min(len(key), 3) - 1
        return xxhash.xxh3_64_intdigest(key) & ~0x3F | shape & 0x3F


def features(texts: list[bytes], cache: TokenHashes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of the texts, and which text each is of. Texts without tokens have none."""
    tokens = [TOKEN.findall(t) for t in texts]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    h = np.fromiter((cache[x] for t in tokens for x in t), np.uint64, sizes.sum())
    own = np.repeat(np.arange(len(texts)), sizes)
    near = np.zeros(len(h), np.uint64)
    for lag in range(1, 5):
        near[lag:] |= ((h[lag:] == h[:-lag]) & (own[lag:] == own[:-lag])).astype(np.uint64)
    shape = (h & np.uint64(0x3F)) << np.uint64(1) | near
    pair = own[1:] == own[:-1] if len(h) else np.empty(0, bool)
    one, two, three = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A5A5A5A5A5A5A5)
    out = [mixed(h), mixed(h[:-1] * one + h[1:])[pair], mixed(shape + two), mixed((shape[:-1] << np.uint64(16)) + shape[1:] + three)[pair]]
    return np.concatenate(out) % np.uint64(BUCKETS), np.concatenate([own, own[1:][pair], own, own[1:][pair]])


def labelled(labels: DataFrame, most: int) -> DataFrame:
    """At most `most` labelled documents: doc_id, good. A document that is labelled more than once is good if all say so."""
    one = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("its_doc")).agg((F.min("quality") >= 1).alias("good"))
    return one.orderBy(F.xxhash64("its_doc"), "its_doc").limit(most)


def fit(docs: DataFrame) -> np.ndarray:
    """For each bucket, log p(target) - log p(raw); docs: text, good (null: not labelled)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, cache = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), cached(TokenHashes)
        for b in batches:
            texts, good = b["text"].to_pylist(), np.array([x is True for x in b["good"].to_pylist()], bool)
            for lo, hi in chunks(texts, 1 << 20):
                bucket, own = features(texts[lo:hi], cache)
                raw += np.bincount(bucket.astype(np.int64), minlength=BUCKETS)
                target += np.bincount(bucket[good[lo:hi][own]].astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])
        tidy()

    sums = as_bytes(docs).select("text", "good").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.ones(BUCKETS), np.zeros(BUCKETS)
    raw[sums["bucket"].to_numpy()] += sums["raw"].to_numpy()
    target[sums["bucket"].to_numpy()] = sums["target"].to_numpy()
    # what the raw model expects of the target, and what came; both raised, so that rare features stay near a ratio of 1
    return np.log((target + PRIOR) / (raw / raw.sum() * target.sum() + PRIOR))


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """docs (text and columns to keep) with log_weight in place of text: the mean of the four kinds of feature, summed over
    the text's tokens and tempered to EVIDENCE of them."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    kept = [c for c in docs.columns if c != "text"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, cache = sent.value, cached(TokenHashes)
        for b in batches:
            texts, out = b["text"].to_pylist(), np.zeros(len(b))
            for lo, hi in chunks(texts, 1 << 20):
                bucket, own = features(texts[lo:hi], cache)
                size = np.bincount(own, minlength=hi - lo) / 4  # about as many as tokens
                out[lo:hi] = np.bincount(own, ratios[bucket.astype(np.int64)], hi - lo) / 4 * np.minimum(1, EVIDENCE / np.maximum(size, 1))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(out)], [*kept, "log_weight"])
        tidy()

    schema = T.StructType([*(f for f in docs.schema if f.name != "text"), T.StructField("log_weight", T.DoubleType())])
    return as_bytes(docs).select(*kept, "text").mapInArrow(each, schema)


def gumbel(seed: int = SEED):
    """Gumbel noise that a document's id and the seed determine."""
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return -F.log(-F.log(u))


def last_of_k(scored: DataFrame, k: int, col: str = "noisy", ranked: int = RANKED) -> tuple[float, int] | None:
    """The k-th largest value and its doc_id (ties: the smaller doc_id comes first); None if all rows are among the k.

    Approximate quantiles narrow the interval that holds the k-th value until it has at most `ranked` rows, or one value.
    """
    total = scored.count()
    if k >= total:
        return None
    if k <= 0:
        return math.inf, 0
    low, high, above, between = -math.inf, math.inf, 0, total
    slack = 0.002  # twenty times what a quantile's rank may be off
    while between > ranked and low < high:
        share = 1 - (k - above) / between
        q = scored.filter(F.col(col).between(low, high)).agg(F.percentile_approx(col, F.array(F.lit(max(0.0, share - slack)), F.lit(min(1.0, share + slack))), 10_000).alias("q")).first()["q"]
        more, rest = scored.agg(F.count_if(F.col(col) > q[1]), F.count_if(F.col(col).between(*q))).first()
        if not more < k <= more + rest or rest == between:
            break
        (low, high), above, between = q, more, rest
    rows = scored.filter(F.col(col).between(low, high)).select(col, F.coalesce("doc_id", F.lit(NO_ID)).alias("d"))
    last = rows.orderBy(F.desc(col), "d").limit(k - above).agg(F.min(F.struct(F.col(col).alias("v"), (-F.col("d")).alias("d"))).alias("m")).first()["m"]
    return last["v"], -last["d"]


def among(last: tuple[float, int] | None, col: str = "noisy"):
    """Whether a row comes no later than the given one."""
    if last is None:
        return F.lit(True)
    return (F.col(col) > last[0]) | ((F.col(col) == last[0]) & (F.coalesce("doc_id", F.lit(NO_ID)) <= last[1]))


def draw(docs: DataFrame, labels: DataFrame, share: float | None = None, most: int = LABELLED, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text_hash, log_weight, noisy, kept.

    The target model is fitted on the labelled good documents. The number to draw, k, is `share` of all rows, rounded;
    without a share that of the good ones among the labelled. Without labels all are drawn. Null or empty text: weight 0.
    Rows with the same doc_id and text are drawn or left together, so the last of the k may bring its equals.
    """
    ship(docs.sparkSession)
    told = labelled(labels, most)  # at most `most` rows
    if share is None:
        share = told.agg(F.avg(F.col("good").cast("double"))).first()[0]
    docs = docs.select("doc_id", "text").join(F.broadcast(told), F.col("doc_id") == told["its_doc"], "left").drop("its_doc")
    ratios = fit(docs)
    scored = weigh(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), ratios)
    scored = stored(scored.withColumn("noisy", F.col("log_weight") + gumbel(seed)), "weights")
    k = scored.count() if share is None else round(share * scored.count())
    return scored.withColumn("kept", among(last_of_k(scored, k)))


def drawn(docs: DataFrame, labels: DataFrame, share: float | None = None, most: int = LABELLED, seed: int = SEED) -> DataFrame:
    """The rows of docs that are drawn, with all their columns, whatever their names: see draw()."""
    left = draw(id_text(docs), labels, share, most, seed).filter("not kept")
    return without(docs, left.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("its_doc"), "text_hash").distinct())


def op7_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance weight, and whether it is drawn: see draw()."""
    return draw(id_text(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text_hash")
