"""Mixing sources to target weights with soft membership.

Only DataFrame functions. A naive Bayes classifier, fitted on a labelled table, gives every document a posterior over
domains. Nonnegative rates (how often a document goes into the mix) are then fitted by projected-gradient least
squares, so that the expected tokens of each domain, summed over the posteriors, match the targets.

The classifier sees all words of a text, hashed to BUCKETS, and how often some letters come, for scripts without blanks:
those letters that tell most about the domain (mutual information). It is fitted on at most TAUGHT labelled texts.

A step moves rate i by the domains' relative residuals, weighted by its posterior: that is the gradient in the metric of
the documents' tokens, in which the largest curvature is 1, so the step size is 1. A rate after k steps is a fold over the
k residual vectors; no rates are kept between steps, and each step is one aggregate over (tokens, posterior).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stored

#: Labelled texts (those of the smallest hashes of doc_id) that the classifier is fitted on.
TAUGHT = 4_000
#: Buckets of words, a power of two; letters that are counted.
BUCKETS, LETTERS = 4096, 8
#: A text counts as so many letters, and as so many words, at most: neighbours are not independent.
EVIDENCE = {"letters": 40.0, "words": 20.0}
SMOOTHING = 1.0
#: A posterior is mixed with the prior by this much, so that no domain is ruled out.
DOUBT = 0.001
STEPS = 60
TOLERANCE = 1e-4
#: Exponent of the domains' shares in the default targets: below 1 lifts small domains.
TEMPER = 0.7


def low(text: str = "text") -> Column:
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def bucket(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def telling(sample: DataFrame, letters: int = LETTERS) -> list[str]:
    """The letters that tell most about the domain; sample: domain, low (lower-cased text), each text counting as one."""
    rows = sample.select("domain", F.array_remove(F.split("low", ""), " ").alias("x")).select("domain", F.size("x").alias("size"), F.explode("x").alias("x"))
    counts = rows.groupBy("x", "domain").agg(F.sum(1 / F.col("size")).alias("n"))
    sizes = {r["domain"]: r["n"] for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).collect()}  # a row a domain
    if not sizes:
        return []
    size = F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair))
    n_all = F.sum("n").over(Window.partitionBy("x"))
    told = counts.withColumn("of_x", n_all).groupBy("x").agg(F.sum(F.col("n") * F.log(F.col("n") * sum(sizes.values()) / (F.col("of_x") * size[F.col("domain")]))).alias("told"))
    return [r["x"] for r in told.orderBy(F.desc(F.round("told", 6)), "x").limit(letters).collect()]


def with_letters(df: DataFrame, letters: list[str]) -> DataFrame:
    """df (low) with letters: an array of how often they come, and of how many bytes are left."""
    size = F.octet_length("low")
    rest = size.cast("double")
    df = df.withColumn("letters", F.array(*((size - F.octet_length(F.replace("low", F.lit(x), F.lit("")))) / len(x.encode()) for x in letters)).cast("array<double>"))
    for i, x in enumerate(letters):
        rest = rest - F.get("letters", F.lit(i)) * len(x.encode())
    return df.withColumn("letters", F.concat("letters", F.array(rest)))


def looked_up(places: Column, values: list[float]) -> Column:
    """The sum of the values at some places."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in values)), ",").cast("array<double>")  # folded into a constant
    return F.aggregate(places, F.lit(0.0), lambda a, i: a + F.get(table, i))


@dataclass
class Classifier:
    domains: list[str]
    priors: list[float]
    letters: list[str]
    #: By domain: log probabilities of each letter and of all other bytes, and of each bucket.
    letter_logs: list[list[float]]
    word_logs: list[list[float]]

    def posterior(self, df: DataFrame) -> DataFrame:
        """df (text) with n_tokens and p, the posterior (array by domain). Null, empty or wordless text: p is the prior."""
        df = with_letters(df.withColumn("low", low()), self.letters).withColumn("buckets", F.transform(words_of(F.col("low")), bucket)).drop("low")
        df = df.withColumn("n_tokens", F.size("buckets").cast("long"))
        scores = []
        for prior, letters, words in zip(self.priors, self.letter_logs, self.word_logs):
            of_letters, n_letters = F.lit(0.0), F.lit(0.0)
            for i, x in enumerate(letters):
                of_letters, n_letters = of_letters + F.get("letters", F.lit(i)) * x, n_letters + F.get("letters", F.lit(i))
            of_words = looked_up(F.col("buckets"), words)
            each = ((of_letters, n_letters, EVIDENCE["letters"]), (of_words, F.col("n_tokens"), EVIDENCE["words"]))
            score = F.lit(prior)
            for total, n, most in each:
                score = score + F.when(F.col("n_tokens") > 0, total * F.least(F.lit(1.0), F.lit(most) / F.greatest(n, F.lit(1.0)))).otherwise(0.0)
            scores.append(score)
        df = df.withColumn("scores", F.array(*scores)).drop("letters", "buckets")
        return df.withColumn("p", probabilities(F.col("scores"), self.priors)).drop("scores")


def probabilities(scores: Column, priors: list[float]) -> Column:
    """Scores as probabilities, mixed with the prior."""
    exps = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    doubt = F.array(*(F.lit(DOUBT * math.exp(q)) for q in priors))
    return F.zip_with(exps, doubt, lambda x, d: x / total * (1 - DOUBT) + d)


def fit(labelled: DataFrame) -> Classifier | None:
    """The classifier of labelled texts (domain, text): a bounded number of rows. None if there are none with a domain."""
    sample = stored(labelled.filter("domain is not null and text is not null").select("domain", low().alias("low")), "labelled-texts")
    domains = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().orderBy("domain").collect()}
    if not domains:
        return None
    letters = telling(sample)
    sums = with_letters(sample, letters).groupBy("domain").agg(*(F.sum(F.get("letters", F.lit(i))).alias(f"n{i}") for i in range(len(letters) + 1))).collect()
    by_letter = {r["domain"]: [r[f"n{i}"] + SMOOTHING for i in range(len(letters) + 1)] for r in sums}
    by_word = {d: [SMOOTHING] * BUCKETS for d in domains}
    words = sample.select("domain", F.explode(words_of(F.col("low"))).alias("word")).groupBy("domain", bucket(F.col("word")).alias("b")).count()
    for r in words.collect():  # BUCKETS rows a domain at most
        by_word[r["domain"]][r["b"]] += r["count"]
    discard(sample)

    def logs(of: dict[str, list[float]]) -> list[list[float]]:
        return [[math.log(x / sum(of[d])) for x in of[d]] for d in domains]

    total = sum(domains.values())
    return Classifier(list(domains), [math.log(n / total) for n in domains.values()], letters, logs(by_letter), logs(by_word))


def dot(p: Column, g: Column, n: int) -> Column:
    out = F.get(p, F.lit(0)) * F.get(g, F.lit(0))
    for d in range(1, n):
        out = out + F.get(p, F.lit(d)) * F.get(g, F.lit(d))
    return out


def rate(history: list[list[float]], n: int, floor: float) -> Column:
    """The rate of a document with column p after the steps whose residuals are given; it starts at 1."""
    if not history:
        return F.lit(max(1.0, floor))
    steps = F.array(*(F.array(*(F.lit(x) for x in h)) for h in history))
    return F.aggregate(steps, F.lit(max(1.0, floor)), lambda r, g: F.greatest(F.lit(floor), r - dot(F.col("p"), g, n)))


def targets(sizes: list[float], weights: dict[str, float] | None, domains: list[str], floor: float) -> list[float]:
    """Target tokens of each domain. With a floor the mix is as small as it can be with no domain below floor times its size, else of the corpus's size."""
    total = sum(sizes)
    w = [weights.get(d, 0.0) if weights else (s / total) ** TEMPER for d, s in zip(domains, sizes)]
    w = [x / sum(w) for x in w]
    if floor > 0:
        total = max(floor * s / x for s, x in zip(sizes, w) if x > 0)
    return [total * x for x in w]


def fit_rates(df: DataFrame, domains: list[str], weights: dict[str, float] | None, floor: float) -> tuple[list[list[float]], list[float], list[float]]:
    """Residuals of each step, targets, and the domain totals that the last rates give; df: n_tokens, p."""
    n = len(domains)

    def totals(r: Column) -> list[float]:
        got = df.select((F.col("n_tokens") * r).alias("w"), "p").agg(*(F.coalesce(F.sum(F.col("w") * F.get("p", F.lit(d))), F.lit(0.0)).alias(f"t{d}") for d in range(n))).first()
        return [float(x) for x in got]

    sizes = totals(F.lit(1.0))
    if not sum(sizes):
        return [], [0.0] * n, [0.0] * n
    wanted, history = targets(sizes, weights, domains, floor), []
    now = totals(rate(history, n, floor))
    for _ in range(STEPS):
        step = [(t - w) / s if s else 0.0 for t, w, s in zip(now, wanted, sizes)]
        history.append(step)
        before, now = now, totals(rate(history, n, floor))
        if max(abs(a - b) for a, b in zip(before, now)) <= TOLERANCE * sum(wanted) / n:
            break
    return history, wanted, now


def mix(docs: DataFrame, labels: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, floor: float = 0.0, seed: int = 11, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, the domain column, and others) with n_tokens, p, domains, rate and copies, which replace columns of these names.

    Documents whose doc_id is in labels teach the classifier what the values of the domain column look like (TAUGHT of them); all
    documents, those included, then get their posterior from their text alone. copies is the rate rounded up or
    down at random, by doc_id and text: its expectation is the rate, and equal rows have the same. Without labelled documents
    every rate is 1, and p and domains are empty. Null text: no tokens, the prior as posterior. weights: by domain
    (default: shares to the power TEMPER). keep: the columns of docs to return (default: all).
    """
    added = ["n_tokens", "p", "domains", "rate", "copies"]
    own = [c for c in (docs.columns if keep is None else keep) if c not in added]
    told = labels.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("told_id")).distinct().orderBy(F.xxhash64("told_id"), "told_id").limit(TAUGHT)
    rows = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in own)).alias("own"), F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{domain}`").cast("string").alias("domain"), F.col("text").cast("string").alias("text"))
    model = fit(rows.join(F.broadcast(told), rows["doc_id"] == told["told_id"], "left_semi").select("domain", "text"))  # TAUGHT ids at most
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    if model is None:
        df = rows.withColumns({"n_tokens": F.size(words_of(low())).cast("long"), "p": F.array().cast("array<double>"), "domains": F.array().cast("array<string>"), "rate": F.lit(1.0), "copies": F.lit(1)})
    else:
        domains = model.domains
        slim = stored(model.posterior(rows).drop("text", "domain"), "members")
        history, _, _ = fit_rates(slim.filter("n_tokens > 0").select("n_tokens", "p"), domains, weights, floor)
        df = slim.withColumn("domains", F.array(*(F.lit(d) for d in domains))).withColumn("rate", rate(history, len(domains), floor))
        u = (F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        df = df.withColumn("copies", (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))
    return df.select(*(F.col("own")[c].alias(c) for c in own), *added)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of every document in a mix of the corpus's size with lifted small languages: see mix()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    df = mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
    best = F.array_position("p", F.array_max("p")).cast("int") - 1
    return df.select("doc_id", "n_tokens", F.get("domains", best).alias("domain"), F.array_max("p").alias("membership"), "rate", "copies")
