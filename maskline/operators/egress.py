"""Leaks in outgoing payloads, and the gate that holds payloads back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.functions import patterns as P
from maskline.functions import scalars as S


def runs(df: DataFrame, keys: list[str], text: str, k: int) -> DataFrame:
    """keys, _run: the hashes of the different runs of k characters of a text, in time that grows with its length."""
    chars = df.select(*keys, F.split(text, "").alias("_chars")).filter(F.size("_chars") >= k)
    first = F.slice("_chars", F.lit(1), F.size("_chars") - k + 1)
    run = F.transform(first, lambda c, i: F.xxhash64(c, *(F.get("_chars", i + j) for j in range(1, k))))
    return chars.select(*keys, F.explode(F.array_distinct(run)).alias("_run"))


def met(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """The join of two tables by a shuffle of both, none being sent to the driver: what runs() makes of a small file is many times as
    large as the planner takes it for."""
    return a.hint("merge").join(b.hint("merge"), on, how)


def longest_run(value: Column, text: Column, least: int) -> Column:
    """Length of the longest run of value that stands in text, if it is `least` or more; else 0."""
    n = F.length(value)
    starts = F.sequence(F.lit(1), F.greatest(n - least + 1, F.lit(1)))

    def grown(i: Column) -> Column:
        sizes = F.sequence(F.lit(least), F.greatest(n - i + 1, F.lit(least)))
        return F.array_max(F.transform(sizes, lambda k: F.when((k <= n - i + 1) & F.contains(text, F.substr(value, i, k)), k).otherwise(0)))

    return F.when(n >= least, F.array_max(F.transform(starts, grown))).otherwise(0)


def find_leaks(payloads: DataFrame, secrets: DataFrame, key: str, text: str = "text", least_text: int = 8, least_digits: int = 8, squeeze: bool = False) -> DataFrame:
    """key, secret_id, verbatim, digit_run: known values that reached a payload.

    secrets: secret_id, value. A value leaks if it is `least_text` long and stands in the text, case aside, or if
    `least_digits` of its digits in a row stand in the text's digits; digit_run is the longest such run (else 0). Each value
    is sought by the one of its runs that the fewest values share, digits by all their runs; only keys and hashes of runs
    are shuffled, and the texts of the pairs that meet are fetched by key. Nulls leak nothing; rows with the same key count
    as one payload each.
    """
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    t = F.regexp_replace(t, r"\s+", " ") if squeeze else t
    pay = payloads.select(key, t.alias("_t")).withColumn("_d", S.digits("_t"))
    v = F.lower(F.coalesce("value", F.lit("")))
    v = F.regexp_replace(v, r"\s+", " ") if squeeze else v
    known = secrets.select("secret_id", v.alias("_v")).distinct().withColumn("_vd", S.digits("_v"))
    own = runs(known, ["secret_id", "_v"], "_v", least_text)
    shared = own.groupBy("_run").agg(F.count("*").alias("_n"))
    seeds = met(own, shared, "_run").groupBy("secret_id", "_v").agg(F.min(F.struct("_n", "_run"))["_run"].alias("_run"))
    meet = met(runs(pay, [key], "_t", least_text), seeds.select("secret_id", "_run"), "_run").select(key, "secret_id").distinct()
    verbatim = met(met(meet, pay.select(key, "_t"), key), known.select("secret_id", "_v"), "secret_id")
    verbatim = verbatim.filter((F.length("_v") >= least_text) & F.contains("_t", "_v")).select(key, "secret_id").distinct()
    meet = met(runs(pay, [key], "_d", least_digits), runs(known, ["secret_id"], "_vd", least_digits), "_run").select(key, "secret_id").distinct()
    digit = met(met(meet, pay.select(key, "_d"), key), known.select("secret_id", "_vd"), "secret_id")
    digit = digit.select(key, "secret_id", longest_run(F.col("_vd"), F.col("_d"), least_digits).alias("digit_run")).groupBy(key, "secret_id").agg(F.max("digit_run").alias("digit_run")).filter("digit_run > 0")
    out = met(verbatim.withColumn("verbatim", F.lit(True)), digit, [key, "secret_id"], "full")
    return out.select(key, "secret_id", F.coalesce("verbatim", F.lit(False)).alias("verbatim"), F.coalesce("digit_run", F.lit(0)).alias("digit_run"))


def find_recovered(texts: DataFrame, secrets: DataFrame, survivors: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n_recovered, n_survivors: values recovered (4 characters or 6 digits), and expected texts (key, survivor) that still stand."""
    leaked = find_leaks(texts, secrets, key, text, 4, 6, squeeze=True).groupBy(key).agg(F.count("*").alias("n_recovered"))
    kept = texts.join(survivors, key).filter(F.contains(F.lower(text), F.lower("survivor"))).groupBy(key).agg(F.count("*").alias("n_survivors"))
    return texts.select(key).join(leaked, key, "left").join(kept, key, "left").fillna(0, ["n_recovered", "n_survivors"])


def block_reason(level: str = "budget_level", image: str = "image", verified: str = "redaction_verified", data: str = "data") -> Column:
    """Why a payload is held back; null: it may go. Whatever can't be judged is held back."""
    text = F.coalesce(F.col(data), F.lit(""))
    cards = F.regexp_extract_all(text, F.lit(P.java(P.CARD)), F.lit(0))
    numbers = F.regexp_extract_all(text, F.lit(P.java(P.AADHAAR)), F.lit(0))
    has_image = (F.length(F.coalesce(F.col(image), F.lit(""))) > 0) & (F.coalesce(F.col(level), F.lit(0)) > 0)
    reason = F.when((F.trim(text) == "") & ~has_image, "empty payload")
    reason = reason.when(has_image & ~F.coalesce(F.col(verified), F.lit(False)), "image without verified redaction")
    reason = reason.when(F.exists(cards, S.luhn_valid), "card number")
    return reason.when(F.exists(numbers, S.verhoeff_valid), "identity number")


def egress_gate(payloads: DataFrame) -> DataFrame:
    """payloads with image dropped at level 0, bytes (of what would be sent) and block_reason."""
    out = payloads.withColumn("block_reason", block_reason())
    out = out.withColumn("image", F.when(F.coalesce("budget_level", F.lit(0)) > 0, F.col("image")))
    return out.withColumn("bytes", (F.octet_length(F.coalesce("data", F.lit(""))) + F.octet_length(F.coalesce("image", F.lit("")))).cast("long"))


def disclosure_tier(df: DataFrame, text: str = "text") -> DataFrame:
    """df with level: 3 where a request asks for what is seen, else 0."""
    return df.withColumn("level", F.when(F.lower(F.coalesce(F.col(text), F.lit(""))).rlike("|".join(P.VISUAL)), 3).otherwise(0))


def gate_metrics(gated: DataFrame, every: str = "1 hour") -> DataFrame:
    """For each span of ts: payloads, bytes let through, payloads held back. The same for tables and streams."""
    return gated.groupBy(F.window("ts", every).alias("span")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("block_reason").isNull(), F.col("bytes")).otherwise(0)).alias("bytes_sent"), F.count_if(F.col("block_reason").isNotNull()).alias("n_blocked"))


def safe_url(url: S.ColumnLike) -> Column:
    """Origin and path; what can't be parsed: all before '?', 200 characters at most."""
    u = S.col(url)
    parsed = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+[^?#\s]*)", 1)
    return F.when(parsed != "", parsed).otherwise(F.left(F.split_part(u, F.lit("?"), F.lit(1)), F.lit(200)))
