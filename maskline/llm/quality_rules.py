"""Quality rules with adaptive thresholds: quantile sketches per language and source replace fixed cut-offs.

Only DataFrame functions. A sketch is a table (group, metric, bucket, count) with buckets of constant relative width:
two sketches merge by adding counts, a quantile is off by at most (GAMMA - 1) / 2 of its value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Relative width of a sketch's buckets, and the bucket of zero.
GAMMA = 1.02
ZERO = -1_000_000
#: A text fails beyond the quartiles of its language and source by FENCE times their distance and the metric's slack.
FENCE = 3.0
SLACK = {"word_length": 3.0, "symbols_a_word": 0.1, "repeated_lines": 0.3, "repeated_words": 0.2}
#: Parts that the rows of one language and source are dealt out to for the join with its thresholds.
SALTS = 32


def measures(docs: DataFrame) -> DataFrame:
    """docs (text and columns to keep, whatever their names) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, which replace columns of these names.

    Null or empty text: all 0. Texts of under five words have no window, so no repeated words. Rows are measured one by one.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    names = [c for c in docs.columns if c != "text" and c not in added]
    own = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in names)).alias("own")
    kept = ["own"]
    text = F.coalesce("text", F.lit(""))
    df = docs.select(own, text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"))
    df = df.withColumn("n_words", F.size("words").cast("long")).withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count("text", F.lit(SYMBOL)).cast("long"))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    words = F.col("words")
    runs = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - WINDOW + 1, F.lit(0))), lambda w, i: F.xxhash64(w, *(words[i + k] for k in range(1, WINDOW))))
    df = df.withColumn("runs", runs).drop("text", "lines")
    repeats = F.size(F.array_distinct("runs")) < F.size("runs")
    # only a text with a repeated window is sorted: (hash, place) pairs, so equal windows stand side by side
    df = df.withColumn("pairs", F.when(repeats, F.sort_array(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    pairs = F.col("pairs")
    same = F.filter(pairs, lambda p, j: F.when(j > 0, F.get(pairs, j - 1)["h"] == p["h"]).otherwise(False) | F.coalesce(F.get(pairs, j + 1)["h"] == p["h"], F.lit(False)))
    df = df.withColumn("places", F.sort_array(F.transform(same, lambda p: p["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("places", start, lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    return df.select(*(F.col("own")[c].alias(c) for c in names), "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines")


def ratios() -> dict[str, Column]:
    def share(a: str, b: str) -> Column:
        return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))

    return {"word_length": share("word_chars", "n_words"), "symbols_a_word": share("n_symbols", "n_words"), "repeated_lines": share("n_dup_lines", "n_lines"), "repeated_words": share("n_repeat_words", "n_words")}


def sketch(df: DataFrame, by: list[str], metrics: dict[str, Column]) -> DataFrame:
    """by, metric, bucket, n."""
    bucket = F.when(F.col("x") <= 0, ZERO).otherwise(F.ceil(F.log("x") / F.log(F.lit(GAMMA)))).cast("long")
    rows = df.select(*by, F.explode(F.create_map(*(x for k, v in metrics.items() for x in (F.lit(k), v)))).alias("metric", "x"))
    return rows.select(*by, "metric", bucket.alias("bucket")).groupBy(*by, "metric", "bucket").agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], qs: dict[str, float]) -> DataFrame:
    """by, metric and a column for each quantile: the value of the first bucket that holds at least that share."""
    group = Window.partitionBy(*by, "metric")
    df = sketches.withColumn("up_to", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))
    value = F.when(F.col("bucket") == ZERO, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    return df.groupBy(*by, "metric").agg(*(F.min(F.when(F.col("up_to") >= F.ceil(F.col("all") * q), value)).alias(k) for k, q in qs.items()))


def judge(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source) with the measures, base_failed and kept; null lang or source is a group of its own."""
    by = ["lang", "source"]
    df = stored(measures(docs.select("doc_id", *by, "text")), "quality")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    metrics = ratios()
    q = quantiles(sketch(df, by, metrics), by, {"q1": 0.25, "q3": 0.75})
    slack = F.create_map(*(x for k, v in SLACK.items() for x in (F.lit(k), F.lit(v))))[F.col("metric")]
    reach = FENCE * (F.col("q3") - F.col("q1")) + slack
    limits = q.groupBy(*by).agg(*(F.max(F.when(F.col("metric") == k, F.col("q3") + reach)).alias(f"most_{k}") for k in metrics), F.max(F.when(F.col("metric") == "word_length", F.col("q1") - reach)).alias("least_word_length"))
    limits = limits.select(*(F.col(c).alias(f"its_{c}") for c in by), *limits.columns[2:], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("its_salt"))
    df = df.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    df = df.join(limits, df["lang"].eqNullSafe(limits["its_lang"]) & df["source"].eqNullSafe(limits["its_source"]) & (df["salt"] == limits["its_salt"]), "left")
    within = F.col("base_failed") == F.lit(False)
    for k, v in ratios().items():
        within &= v <= F.col(f"most_{k}")
    within &= ratios()["word_length"] >= F.col("least_word_length")
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(within, F.lit(False)).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and whether it is kept: null texts have no words and fail, equal rows fare alike."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source"))


OP9_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT r, unnest(range(len(words) - 4)) AS i, words FROM w WHERE len(words) >= 5),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i + 1 : i + 5]) AS n FROM g),
p AS (SELECT r, i, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -5) AS gap FROM k WHERE n > 1),
c AS (SELECT r, sum(least(5, gap)) AS n FROM p GROUP BY r),
m AS (
  SELECT r, doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (r)),
f AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
         coalesce(word_chars / nullif(n_words, 0), 0)::DOUBLE AS a, coalesce(n_symbols / nullif(n_words, 0), 0)::DOUBLE AS b,
         coalesce(n_dup_lines / nullif(n_lines, 0), 0)::DOUBLE AS c, coalesce(n_repeat_words / nullif(n_words, 0), 0)::DOUBLE AS d
  FROM m),
u AS (SELECT lang, source, unnest(['a', 'b', 'c', 'd']) AS metric, unnest([a, b, c, d]) AS x FROM f),
s AS (SELECT lang, source, metric, CASE WHEN x <= 0 THEN -1000000 ELSE ceil(ln(x) / ln(1.02::DOUBLE)) END AS bucket, count(*) AS n
      FROM u GROUP BY ALL),
o AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS up_to,
             sum(n) OVER (PARTITION BY lang, source, metric) AS total,
             CASE WHEN bucket = -1000000 THEN 0 ELSE 2 * pow(1.02::DOUBLE, bucket) / 2.02 END AS v FROM s),
q AS (SELECT lang, source, metric, min(v) FILTER (WHERE up_to >= ceil(total * 0.25::DOUBLE)) AS q1,
             min(v) FILTER (WHERE up_to >= ceil(total * 0.75::DOUBLE)) AS q3 FROM o GROUP BY ALL),
l AS (SELECT lang, source, max(q3 + 3 * (q3 - q1) + 3) FILTER (WHERE metric = 'a') AS ma, max(q1 - 3 * (q3 - q1) - 3) FILTER (WHERE metric = 'a') AS la,
             max(q3 + 3 * (q3 - q1) + 0.1) FILTER (WHERE metric = 'b') AS mb, max(q3 + 3 * (q3 - q1) + 0.3) FILTER (WHERE metric = 'c') AS mc,
             max(q3 + 3 * (q3 - q1) + 0.2) FILTER (WHERE metric = 'd') AS md FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND a <= ma AND a >= la AND b <= mb AND c <= mc AND d <= md) AS kept
FROM f JOIN l ON f.lang IS NOT DISTINCT FROM l.lang AND f.source IS NOT DISTINCT FROM l.source
"""
