"""Language ID: an interpolated Kneser-Ney character model (trigrams) for each language, in sorted hash arrays.

A text's letters are lower-cased, other runs become one blank. Each different trigram of a text is looked up once. The
language of the lowest cross-entropy per letter wins. A text is rejected where even that is above what other texts of that
language reach; rejection halves the score, the prediction stays. Thresholds are cross-fitted: the labelled texts are dealt into
two folds by their hashes, so that equal texts share one; each is scored by its language's model of the other fold, and the
REJECT quantile over all of them is the threshold. The two fold models stand beside the whole one as columns of the same tables.

Every task holds the models while they have at most MAX_CELLS values (trigrams times models). Beyond that it holds the final logarithms
of the frequent trigrams alone; the texts' other trigrams go to the part of the models that they need, that of their
middle letter (letters are few and go to all parts), and their logarithms are joined to the texts. All counts are used
either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.plans.session import ship

from .common import each_group, stored, tidy
from .counts import HELD, MOST, Counter, bounded

#: Absolute discount.
DISCOUNT = 0.75
#: Values (trigrams times models) that every task holds; beyond, the rarer trigrams are looked up by a shuffle.
MAX_CELLS = 6_000_000
#: Share of a language's labelled texts, each scored without its own fold, that its threshold lets pass; and the folds.
REJECT, FOLDS = 0.995, 2
UNKNOWN = "und"
BITS = 21
ONE = (1 << BITS) - 1
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter; made once a process."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(text: str) -> tuple[np.ndarray, int]:
    """The trigram codes of a text between blanks, and how many letters it has."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    is_letter = letters()[points]
    n = int(is_letter.sum())
    if not n:
        return np.empty(0, np.int64), 0
    x = np.where(is_letter, points, 32)
    x = np.r_[32, 32, x, 32]
    keep = (x != 32) | np.r_[True, x[:-1] != 32]
    keep[:2] = True
    x = x[keep]
    if x[2] == 32:
        x = x[1:]
    return x[:-2] << 2 * BITS | x[1:-1] << BITS | x[2:], n


def count_languages(docs: DataFrame, languages: list[str]) -> DataFrame:
    """lang (its place among the languages), code, n of the trigrams of text; a task sums its own first."""
    place = {x: i for i, x in enumerate(languages)}

    def rows(lang: int, c: Counter) -> Iterator[pa.RecordBatch]:
        for codes, n in c.batches():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), lang, np.int32)), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [Counter(HELD // len(languages), MOST // len(languages)) for _ in languages]  # together as large as one
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
                codes, n = np.unique(trigrams(text)[0], return_counts=True)
                (c := counters[place[lang]]).add(codes, n)
                if c.full():
                    yield from rows(place[lang], c)
        for i, c in enumerate(counters):
            yield from rows(i, c)
        tidy()

    return docs.select("lang", "text").mapInArrow(count, "lang int, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Models:
    """For all languages at once: sorted trigrams, bigrams and letters, and a column of values for each language.

    With letters (codes, and a column for each language of how many letters each one follows) the trigrams are those of
    some middle letters; only what letters follow needs the others."""

    def __init__(self, languages: list[str], lang: np.ndarray, codes: np.ndarray, counts: np.ndarray, letters: tuple[np.ndarray, np.ndarray] | None = None):
        k = len(languages)
        self.languages = languages
        pair, single = (1 << 2 * BITS) - 1, ONE
        self.grams, g = np.unique(codes, return_inverse=True)
        count = np.zeros((len(self.grams), k))
        count[g, lang] = counts
        self.pairs, suffix = np.unique(self.grams & pair, return_inverse=True)
        self.heads, head = np.unique(self.grams >> BITS, return_inverse=True)
        self.chars, last = np.unique(self.pairs & single, return_inverse=True)
        if letters is not None:
            self.chars, last = letters[0], np.searchsorted(letters[0], self.pairs & single)
        self.firsts, first = np.unique(self.pairs >> BITS, return_inverse=True)

        def summed(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
            return np.stack([np.bincount(at, values[:, j], n) for j in range(k)], 1)

        seen = (count > 0).astype(float)
        before = summed(seen, suffix, len(self.pairs))  # different letters before a pair
        follow = (before > 0).astype(float)
        char = summed(follow, last, len(self.chars)) if letters is None else letters[1]
        size = len(self.chars) + 1
        every = np.maximum(char.sum(0), 1)
        kinds = (char > 0).sum(0)
        self.p0 = np.where(kinds > 0, DISCOUNT * kinds / every, 1.0) / size
        self.p1 = np.maximum(char - DISCOUNT, 0) / every + self.p0
        total2 = summed(before, first, len(self.firsts))
        self.w2 = np.where(total2 > 0, DISCOUNT * summed(follow, first, len(self.firsts)) / np.maximum(total2, 1), 1.0)
        self.p2 = np.where(total2[first] > 0, np.maximum(before - DISCOUNT, 0) / np.maximum(total2[first], 1), 0) + self.w2[first] * self.p1[last]
        total3 = summed(count, head, len(self.heads))
        self.w3 = np.where(total3 > 0, DISCOUNT * summed(seen, head, len(self.heads)) / np.maximum(total3, 1), 1.0)
        self.p3 = np.where(total3[head] > 0, np.maximum(count - DISCOUNT, 0) / np.maximum(total3[head], 1), 0) + self.w3[head] * self.p2[suffix]

    @staticmethod
    def look(table: np.ndarray, keys: np.ndarray, values: np.ndarray, other: np.ndarray | float) -> np.ndarray:
        if not len(table):
            return np.broadcast_to(other, (len(keys), values.shape[1]))
        at = np.searchsorted(table, keys)
        at[at == len(table)] = 0
        return np.where((table[at] == keys)[:, None], values[at], other)

    def log2(self, codes: np.ndarray) -> np.ndarray:
        p = np.array(self.look(self.grams, codes, self.p3, 0.0))  # no probability is 0
        if len(miss := np.flatnonzero(p[:, 0] == 0)):
            c = codes[miss]
            p1 = self.look(self.chars, c & ONE, self.p1, self.p0)
            p2 = self.look(self.firsts, c >> BITS & ONE, self.w2, 1.0) * p1
            p2 = self.look(self.pairs, c & ((1 << 2 * BITS) - 1), self.p2, p2)
            p[miss] = self.look(self.heads, c >> BITS, self.w3, 1.0) * p2
        return np.log2(p)


def fold(text: str = "text") -> Column:
    return F.pmod(F.xxhash64(F.col(text), F.lit("fold")), F.lit(FOLDS)).cast("int")


def taught(docs: DataFrame, languages: list[str]) -> DataFrame:
    """lang, code, n: the trigram counts of the rows that teach. lang: i for all of the i-th language's texts, i + (1 + f) * languages for
    those that aren't in fold f."""
    k = len(languages)
    parts = [f"{x}\0{f}" for f in range(FOLDS) for x in languages]
    rows = stored(count_languages(docs.select(F.concat("lang", F.lit("\0"), fold()).alias("lang"), "text"), parts), "trigrams")
    own, f = F.col("lang") % k, F.floor(F.col("lang") / k).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.lit(FOLDS - 1)), lambda x: x != f)
    into = F.explode(F.concat(F.array(own), F.transform(others, lambda x: own + (1 + x) * k)))
    return stored(rows.select(into.alias("lang"), "code", "n").groupBy(F.col("lang").cast("int").alias("lang"), "code").agg(F.sum("n").alias("n")), "trigrams")


def columns(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return rows["lang"].to_numpy(), rows["code"].to_numpy(), rows["n"].to_numpy()


def part_models(grams: DataFrame, languages: list[str], asked: DataFrame | None = None) -> DataFrame:
    """code, logs (a language each): log2 probabilities of the asked trigrams, or of all known ones, by their middle letter."""
    follow = grams.select("lang", F.col("code").bitwiseAND(F.lit((1 << 2 * BITS) - 1)).alias("pair")).distinct()
    rows = follow.groupBy("lang", F.col("pair").bitwiseAND(F.lit(ONE)).alias("code")).agg(F.count("*").alias("n")).toArrow()  # as many as the languages have letters
    lang, code, n = columns(rows)
    chars, at = np.unique(code, return_inverse=True)
    values = np.zeros((len(chars), len(languages)))
    values[at, lang] = n
    sent = grams.sparkSession.sparkContext.broadcast((chars, values))
    part = F.shiftright("code", BITS).bitwiseAND(F.lit(ONE)).alias("part")
    rows, every = grams.select(part, "lang", "code", "n"), asked is None
    if not every:
        rows = rows.unionByName(asked.select("code").distinct().select(part, F.lit(0).alias("lang"), "code", F.lit(0).cast("long").alias("n")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_group(batches, "part"):
            lang, code, n = columns(t)
            wanted = np.unique(code) if every else code[n == 0]
            models = Models(languages, lang[n > 0], code[n > 0], n[n > 0], sent.value)
            for lo in range(0, len(wanted), 1 << 12):
                some = wanted[lo : lo + (1 << 12)]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(models.log2(some)), pa.list_(pa.float64()))], ["code", "logs"])
        tidy()

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(each, "code long, logs array<double>")


def frequent(grams: DataFrame, languages: list[str], max_grams: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent trigrams, sorted, and their log2 probabilities in each language."""
    head = bounded(grams.groupBy("code").agg(F.sum("n").alias("n")), max_grams).select("code")
    rows = part_models(grams, languages).join(head, "code").toArrow()
    codes = rows["code"].to_numpy()
    logs = rows["logs"].combine_chunks().flatten().to_numpy().reshape(len(codes), len(languages))
    order = np.argsort(codes)
    return codes[order], logs[order]


def entropies(docs: DataFrame, grams: DataFrame, languages: list[str], max_grams: int) -> DataFrame:
    """docs (text and a column `own`) -> own, n (trigrams), sums (a language each): log2 probabilities of the text's trigrams."""
    k = len(languages)
    fits = grams.select("code").distinct().count() <= max_grams
    sent = grams.sparkSession.sparkContext.broadcast(Models(languages, *columns(grams.toArrow())) if fits else frequent(grams, languages, max_grams))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = sent.value
        for b in batches:
            sizes, sums, tail, tail_n = [], [], [], []
            for text in b["text"].to_pylist():
                codes, _ = trigrams(text or "")
                sizes.append(len(codes))
                codes, n = np.unique(codes, return_counts=True)
                if fits:
                    sums.append(n @ head.log2(codes) if len(codes) else np.zeros(k))
                    tail.append(None), tail_n.append(None)
                    continue
                at = np.minimum(np.searchsorted(head[0], codes), max(0, len(head[0]) - 1))
                hit = head[0][at] == codes if len(head[0]) else np.zeros(len(codes), bool)
                sums.append(n[hit] @ head[1][at[hit]] if hit.any() else np.zeros(k))
                tail.append(None if hit.all() else codes[~hit]), tail_n.append(None if hit.all() else n[~hit])
            yield pa.RecordBatch.from_arrays([b["own"], pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.float64())), pa.array(tail, pa.list_(pa.int64())), pa.array(tail_n, pa.list_(pa.int64()))], ["own", "n", "sums", "tail", "tail_n"])
        tidy()

    kind = docs.schema["own"].dataType.simpleString()
    found = docs.select("own", "text").mapInArrow(each, f"own {kind}, n long, sums array<double>, tail array<long>, tail_n array<long>")
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "entropies")
    if fits:
        return found.select("own", "n", "sums")
    tail = found.filter("tail is not null").select("row", F.inline(F.arrays_zip(F.col("tail").alias("code"), F.col("tail_n").alias("times"))))
    tail = tail.join(part_models(grams, languages, tail), "code")
    tail = tail.groupBy("row").agg(F.array(*(F.sum(F.get("logs", F.lit(i)) * F.col("times")) for i in range(k))).alias("more"))
    sums = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda x, y: x + y))
    return found.join(tail, "row", "left").select("own", "n", sums.alias("sums"))


def identify(docs: DataFrame, reject: float = REJECT, max_cells: int = MAX_CELLS) -> DataFrame:
    """docs (doc_id, text, lang, held_out): learns from the rows not held out, predicts all from their text alone.

    Returns doc_id, held_out, lang_pred, bits (a letter, in that language), score, rejected. Null text or none of letters:
    'und', score 0, bits null, rejected; without a row that teaches, so are all. Ties: the first language by name. Rows with
    the same doc_id are judged one by one.
    """
    ship(docs.sparkSession)
    known = docs.filter("not held_out and lang is not null and text is not null")
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    own = F.struct("doc_id", "held_out", F.when(~F.col("held_out"), F.col("lang")).alias("told"), fold().alias("fold"))
    grams = taught(known, languages) if languages else None
    if grams is None or grams.isEmpty():
        none = F.lit(None).cast("double")
        return docs.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), none.alias("bits"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    k, models = len(languages), [*languages, *(f"{x}\0{f}" for f in range(FOLDS) for x in languages)]
    found = entropies(docs.select(own.alias("own"), "text"), grams, models, max_cells // len(models))
    found = found.withColumns({"all": F.col("sums"), "sums": F.slice("sums", 1, k)})
    best = F.array_max("sums")
    names = F.array(*(F.lit(x) for x in languages))
    odds = F.aggregate("sums", F.lit(0.0), lambda a, x: a + F.pow(F.lit(2.0), (x - best) / F.sqrt("n")))
    some, place = F.col("n") > 0, (F.array_position("sums", best) - 1).cast("int")
    apart = F.get("all", place + (1 + F.col("own.fold")) * k)  # by the model without the text's fold
    found = found.select("own.*", F.when(some, F.get(names, place)).otherwise(UNKNOWN).alias("lang_pred"), F.when(some, -best / F.col("n")).alias("bits"), F.when(some, -apart / F.col("n")).alias("bits_apart"), F.when(some, 1 / odds).otherwise(0.0).alias("score"))
    limits = found.filter("told = lang_pred").groupBy("lang_pred").agg(F.percentile_approx("bits_apart", reject, 10_000).alias("most")).collect()  # a row a language
    most = F.lit(None).cast("double")
    for r in limits:
        most = F.when(F.col("lang_pred") == r["lang_pred"], r["most"]).otherwise(most)
    # a text that taught is judged by the model without it, like one that didn't
    rejected = F.coalesce(F.when(F.col("told") == F.col("lang_pred"), F.col("bits_apart")).otherwise(F.col("bits")) > most, F.col("lang_pred") == UNKNOWN)
    return found.select("doc_id", "held_out", "lang_pred", "bits", F.when(rejected, F.col("score") / 2).otherwise(F.col("score")).alias("score"), rejected.alias("rejected"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts every document's language from those of crc32(doc_id) mod 4 other than 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "lang", "text"))
