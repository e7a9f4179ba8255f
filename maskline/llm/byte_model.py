"""LM scoring by partial matching (PPM): a byte-context trie, escapes by method D, symbol exclusion.

The trie is learnt from a training corpus: Spark counts all byte runs of ORDER + 1 bytes; contexts of every lower order
follow from them. Each text is scored by the code length that the trie gives its bytes and an end mark.

A context's symbols are also symbols of its suffix, so what is excluded after an escape depends on the context that
was left alone; denominators after an escape are therefore stored with that context, and scoring is table look-up.

Every task holds the trie while the corpus has at most MAX_RUNS different runs. Beyond that it holds the final logarithms
of the frequent runs alone; the texts' other runs go to the part of the trie that they need, which is that of their last
few context bytes (as many as leave at most MAX_BASE runs of lower orders, which all parts get), and their logarithms are
joined to the texts. All counts are used either way: the bounds decide where a run is looked up, not what it costs.
"""

from __future__ import annotations

from collections import Counter as Tally
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, chunks, each_group, id_text, stored, tidy
from .counts import Counter, bounded

ORDER = 5
#: UTF-8 has neither byte: START stands before a text, END is coded after it.
START, END = 0xFF, 0xFE
SYMBOLS = 255
#: Runs of ORDER + 1 bytes that every task holds (24 bytes each); beyond, the rarer ones are looked up by a shuffle.
MAX_RUNS = 3_000_000
#: Runs of lower orders that all parts of the trie get, at most; runs of two bytes always fit.
MAX_BASE = 1 << 20
#: Words whose counts every task holds (16 bytes each); the others' counts are joined.
FREQUENT = 1 << 18
#: Bytes that are scored together.
CHUNK = 1 << 20


def run_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end mark of the texts: the run that ends there, as a number, and which text it is of."""
    pad = bytes([START]) * ORDER
    data = np.frombuffer(b"".join([x for t in texts for x in (pad, t, bytes([END]))]), np.uint8).astype(np.int64)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    n = len(data) - ORDER
    codes = np.zeros(max(n, 0), np.int64)
    for i in range(ORDER + 1):
        codes <<= 8
        codes |= data[i : i + n]
    keep = data[ORDER:] != START
    return codes[keep], np.repeat(np.arange(len(texts)), sizes)


def word_codes(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n).view(np.int64)


def count_corpus(docs: DataFrame) -> DataFrame:
    """kind, code, n: byte runs (kind 0) and words, by their hash (kind 1), of all given texts; summed by the tasks first."""

    def rows(kind: int, counter: Counter) -> Iterator[pa.RecordBatch]:
        for codes, n in counter.batches():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), kind, np.int32)), pa.array(codes), pa.array(n)], ["kind", "code", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, words = Counter(), Counter()
        for b in batches:
            texts = [t.lower() for t in b["text"].to_pylist()]
            for lo, hi in chunks(texts, CHUNK):
                codes, n = np.unique(run_codes(texts[lo:hi])[0], return_counts=True)
                runs.add(codes, n)
                tally = Tally(b" ".join(texts[lo:hi]).split())
                words.add(word_codes(tally, len(tally)), np.fromiter(tally.values(), np.int64, len(tally)))
                for kind, counter in ((0, runs), (1, words)):
                    if counter.full():
                        yield from rows(kind, counter)
        for kind, counter in ((0, runs), (1, words)):
            yield from rows(kind, counter)
        tidy()

    return as_bytes(docs.select("text")).mapInArrow(count, "kind int, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))


class Trie:
    """Tables by order: sorted runs with the logarithm of their counts; sorted contexts with the logarithms of
    denominator and escape, when entered first and when their suffix is entered from them. With base (runs of `shared` bytes
    of the whole corpus, and their counts) the codes are those of a part, and orders below `shared` come from base."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, base: tuple[np.ndarray, np.ndarray] | None = None, shared: int = 0):
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
        self.runs, self.run_log, self.contexts, self.enter, self.escape, self.next_enter, self.next_escape = ([None] * (ORDER + 1) for _ in range(7))
        lower = None
        for k in range(ORDER + 1):
            told, seen = base if k < shared else (codes, counts)
            runs, at = np.unique(told & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(at, seen, len(runs)) if len(runs) else np.empty(0)
            contexts, own = np.unique(runs >> 8, return_inverse=True)
            total, kinds = np.bincount(own, n, len(contexts)), np.bincount(own, minlength=len(contexts)).astype(float)
            # method D: a symbol seen c of T times has (2c - 1) / 2T, the escape from q symbols q / 2T
            self.runs[k], self.run_log[k], self.contexts[k] = runs, np.log10(2 * n - 1), contexts
            self.enter[k], self.escape[k] = np.log10(2 * total), np.log10(kinds)
            if k:  # the suffix, without this context's symbols
                at = np.searchsorted(lower[0], runs & ((1 << 8 * k) - 1))
                excluded = np.bincount(own, lower[1][at], len(contexts))
                suffix = np.searchsorted(lower[2], contexts & ((1 << 8 * (k - 1)) - 1))
                rest, left = lower[3][suffix] - excluded, lower[4][suffix] - kinds
                with np.errstate(divide="ignore"):
                    self.next_enter[k], self.next_escape[k] = np.log10(2 * rest), np.log10(left)
            lower = runs, n, contexts, total, kinds
        self.unseen = -np.log10(max(1, SYMBOLS - len(self.runs[0])))

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each run's last byte after the bytes before it."""
        out, todo = np.zeros(len(codes)), np.arange(len(codes))
        left = np.full(len(codes), -1)  # the context that was left for the one at hand, if any
        for k in range(ORDER, -1, -1):
            runs = codes[todo] & ((1 << 8 * (k + 1)) - 1)
            at, known = find(self.contexts[k], runs >> 8)
            if not known.all():  # such a context was never seen: no cost, nothing is excluded
                at, runs, going = at[known], runs[known], todo[known]
            else:
                going = todo
            come = left[going]
            enter, escape, after = self.enter[k][at], self.escape[k][at], come >= 0
            if after.any():
                enter[after], escape[after] = self.next_enter[k + 1][come[after]], self.next_escape[k + 1][come[after]]
            run, hit = find(self.runs[k], runs)
            out[going[hit]] += self.run_log[k][run[hit]] - enter[hit]
            miss = ~hit
            paid = miss & np.isfinite(escape)  # else nothing is left to code here: the escape is certain
            out[going[paid]] += escape[paid] - enter[paid]
            left[going[miss]] = at[miss]
            done = np.zeros(len(codes), bool)
            done[going[hit]] = True
            todo = todo[~done[todo]]
            if not len(todo):
                return out
        out[todo] += self.unseen
        return out


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in the sorted table, and whether it does."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


#: Bits for the number of a text in a chunk: see chunks().
TEXT_BITS = 14


def sorted_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different runs of some texts, in order; where each one's places begin; and the texts of all places, by run."""
    codes, text = run_codes(texts)
    keys = np.sort(codes << TEXT_BITS | text)
    text, codes = keys & ((1 << TEXT_BITS) - 1), keys >> TEXT_BITS
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, np.int64)
    return codes[first], first, text


def text_scores(trie: Trie, texts: list[bytes]) -> np.ndarray:
    """log10 probability of each text: each different run of a chunk of texts is looked up once."""
    out = np.zeros(len(texts))
    for lo, hi in chunks(texts, CHUNK):
        runs, first, text = sorted_runs(texts[lo:hi])
        out[lo:hi] = np.bincount(text, np.repeat(trie.log10(runs), np.diff(first, append=len(text))), hi - lo)
    return out


def head_scores(head: tuple[np.ndarray, np.ndarray], texts: list[bytes]) -> tuple[np.ndarray, list, list]:
    """log10 of what the head holds of each text; each text's other runs and how often they come (None: no others)."""
    out, codes_of, counts_of = np.zeros(len(texts)), [None] * len(texts), [None] * len(texts)
    for lo, hi in chunks(texts, CHUNK):
        runs, first, text = sorted_runs(texts[lo:hi])
        at, hit = find(head[0], runs)
        times = np.diff(first, append=len(text))
        out[lo:hi] = np.bincount(text, np.repeat(np.where(hit, head[1][at], 0.0) if len(head[0]) else np.zeros(len(runs)), times), hi - lo)
        if hit.all():
            continue
        other = np.repeat(~hit, times)
        keys, n = np.unique(text[other] << 8 * (ORDER + 1) | np.repeat(runs[~hit], times[~hit]), return_counts=True)
        text, keys = keys >> 8 * (ORDER + 1), keys & ((1 << 8 * (ORDER + 1)) - 1)
        ends = np.searchsorted(text, np.arange(hi - lo + 1))
        for i in np.unique(text):
            codes_of[lo + i], counts_of[lo + i] = keys[ends[i] : ends[i + 1]], n[ends[i] : ends[i + 1]]
    return out, codes_of, counts_of


def word_scores(words: tuple[np.ndarray, np.ndarray, np.ndarray], texts: list[bytes], whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Of each text: its words, those that the table (codes, counts, their logarithms) has, the sum of their logarithms, and
    the codes of the others (None if there are none, or if the table is the whole vocabulary)."""
    codes, _, logs = words
    n_words, known, sums, rare = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts)), [None] * len(texts)
    for lo, hi in chunks(texts, CHUNK):
        split = [t.split() for t in texts[lo:hi]]
        sizes = np.fromiter(map(len, split), np.int64, hi - lo)
        number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        each = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, sizes.sum())
        own, hashes = np.repeat(np.arange(hi - lo), sizes), word_codes(number, len(number))
        at, hit = find(codes, hashes)
        n_words[lo:hi] = sizes
        known[lo:hi] = np.bincount(own, hit[each], hi - lo)
        sums[lo:hi] = np.bincount(own, (np.where(hit, logs[at], 0.0) if len(codes) else np.zeros(len(hashes)))[each], hi - lo)
        if not whole and not hit.all():
            other = np.flatnonzero(~hit[each])
            ends = np.searchsorted(own[other], np.arange(hi - lo + 1))
            for i in np.unique(own[other]):
                rare[lo + i] = hashes[each[other[ends[i] : ends[i + 1]]]]
    return n_words, known, sums, rare


def learn(runs: DataFrame) -> Trie:
    """The whole trie; runs: code, n."""
    rows = runs.toArrow()
    return Trie(rows["code"].to_numpy(), rows["n"].to_numpy())


def frequent_runs(runs: DataFrame, max_runs: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent runs, sorted, and their log10 probabilities, which follow from all counts of their contexts."""
    totals = runs.groupBy(F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("total"))
    head = bounded(runs, max_runs).withColumn("context", F.shiftright("code", 8)).join(totals, "context")
    rows = head.select("code", (F.log10(2 * F.col("n") - 1) - F.log10(2 * F.col("total"))).alias("log")).toArrow()
    codes, logs = rows["code"].to_numpy(), rows["log"].to_numpy()
    order = np.argsort(codes)
    return codes[order], logs[order]


def last_bytes(runs: DataFrame, n: int) -> DataFrame:
    """code, n: the counts of runs of n bytes."""
    return runs.groupBy(F.col("code").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("code")).agg(F.sum("n").alias("n"))


def looked_up(runs: DataFrame, asked: DataFrame, max_base: int = MAX_BASE) -> DataFrame:
    """code, log: the log10 probability of every asked code, from the part of the trie that holds its contexts.

    The longer the shared contexts, the smaller a part: the longest of which there are at most max_base is taken."""
    shared = next((k for k in range(ORDER - 1, 2, -1) if last_bytes(runs, k).count() <= max_base), 2)
    low = last_bytes(runs, shared).toArrow()  # max_base rows at most, or 2^16
    base = runs.sparkSession.sparkContext.broadcast((low["code"].to_numpy(), low["n"].to_numpy()))
    part = F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * shared) - 1)).alias("part")
    rows = runs.select(part, "code", "n").unionByName(asked.select("code").distinct().select(part, "code", F.lit(0).cast("long").alias("n")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for t in each_group(batches, "part"):
            codes, n = t["code"].to_numpy(), t["n"].to_numpy()
            if (n == 0).any():
                out.append((codes[n == 0], Trie(codes[n > 0], n[n > 0], base.value, shared).log10(codes[n == 0])))
                held += len(out[-1][0])
            if held > 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["code", "log"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["code", "log"])
        tidy()

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(each, "code long, log double")


def score(docs: DataFrame, training: DataFrame, max_runs: int = MAX_RUNS, frequent: int = FREQUENT, max_base: int = MAX_BASE) -> DataFrame:
    """docs (doc_id, text and columns to keep, whatever their names) with n_tokens, n_known, train_tokens, base_score and
    score, which replace columns of these names.

    A-Z are lower-cased. Null or empty text: the end alone. Without training texts the trie is empty: each byte costs
    log10(255), no token is known. Rows with the same doc_id are scored one by one.
    """
    spark = docs.sparkSession
    counts = stored(count_corpus(training), "corpus-counts")
    ends = training.count()
    n_words, n_kinds = counts.filter("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, base = n_words + ends, float(np.log10(n_words + ends + n_kinds + bool(ends) + 1))
    words = counts.filter("kind = 1").select("code", "n")
    top = bounded(words, frequent).toArrow()
    order = np.argsort(top["code"].to_numpy())
    runs = counts.filter("kind = 0").select("code", "n")
    fits = runs.count() <= max_runs
    sent = spark.sparkContext.broadcast((learn(runs) if fits else frequent_runs(runs, max_runs), top["code"].to_numpy()[order], top["n"].to_numpy()[order]))
    whole = n_kinds <= len(order)
    kept = [c for c in docs.columns if c != "text"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, codes, counts = sent.value
        table = codes, counts, np.log10(counts + 1)
        for b in batches:
            texts = [t.lower() for t in b["text"].to_pylist()]
            scores, tail, tail_n = (text_scores(trie, texts), [None] * len(texts), [None] * len(texts)) if fits else head_scores(trie, texts)
            words, known, sums, rare = word_scores(table, texts, whole)
            sums += np.log10(ends + 1) - (words + 1) * base
            yield pa.RecordBatch.from_arrays([b["own"], pa.array(words + 1), pa.array(known + bool(ends)), pa.array(sums), pa.array(scores), *(pa.array(x, pa.list_(pa.int64())) for x in (rare, tail, tail_n))], ["own", "n_tokens", "n_known", "base_score", "score", "rare", "tail", "tail_n"])
        tidy()

    own = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("own")
    kind = docs.select(own).schema["own"].dataType.simpleString()
    scored = as_bytes(docs.select(own, "text")).mapInArrow(each, f"own {kind}, n_tokens long, n_known long, base_score double, score double, rare array<long>, tail array<long>, tail_n array<long>")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    more = scored.filter("rare is not null").select("row", F.explode("rare").alias("code")).join(words, "code")
    more = more.groupBy("row").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("n") + 1)).alias("more"))
    if not fits:
        tail = scored.filter("tail is not null").select("row", F.inline(F.arrays_zip(F.col("tail").alias("code"), F.col("tail_n").alias("times"))))
        tail = tail.join(looked_up(runs, tail, max_base), "code").groupBy("row").agg(F.sum(F.col("log") * F.col("times")).alias("rest"))
        scored = scored.join(tail, "row", "left").withColumn("score", F.col("score") + F.coalesce("rest", F.lit(0.0))).drop("rest")
    out = scored.drop("rare", "tail", "tail_n").join(more, "row", "left")
    found = {"n_tokens": F.col("n_tokens"), "n_known": F.col("n_known") + F.coalesce("more_known", F.lit(0)), "train_tokens": F.lit(total).cast("long"), "base_score": F.col("base_score") + F.coalesce("more", F.lit(0.0)), "score": F.col("score")}
    return out.select(*(F.col("own")[c].alias(c) for c in kept if c not in found), *(v.alias(k) for k, v in found.items()))


def op6_byte_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents with what all but those of crc32(doc_id) mod 7 = 2 teach."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = id_text(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", held.alias("held_out"), "text")
    return score(docs, docs.filter(~F.col("held_out")))
