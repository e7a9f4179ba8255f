"""Exact nearest ranks of large groups: counts by buckets narrow the range of a rank, round by round, until one value is left.

No task ever holds or sorts a group's values: a round is a partial aggregate of at most BUCKETS rows for each group and rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskline.sources.tables import discard, stored

BUCKETS = 8192
#: Ranges (one for each group and rank) that may be sent to all tasks; more are joined by a shuffle, whose skewed parts Spark splits.
BROADCAST_RANGES = 200_000


def nearest_ranks(df: DataFrame, by: list[str], value: str, shares: dict[str, float], buckets: int = BUCKETS) -> DataFrame:
    """by, n and a column for each share p of the group's n values: the value at place ceil(p * n) of their order, 1 at least.

    Nulls, NaN and infinite values are left out; groups without others don't appear. Null keys are groups of their own. The
    values of a group aren't moved while the ranges can be sent to them."""
    keys = [f"_k{i}" for i in range(len(by))]
    v = F.col(value).cast("double")
    rows = df.select(*(F.struct(F.col(b)).alias(k) for b, k in zip(by, keys)), v.alias("_v")).filter(F.abs("_v") < float("inf"))  # a struct is never null
    if not keys:
        rows, keys = rows.withColumn("_k0", F.struct(F.lit(1).alias("all"))), ["_k0"]
    rows = stored(rows, "values")
    sizes = stored(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "sizes")
    ranks = F.explode(F.array(*(F.struct(F.lit(name).alias("share"), F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)).cast("long").alias("rank")) for name, p in shares.items())))
    found = sizes.select(*keys, ranks.alias("_r"), "_lo", "_hi").select(*keys, "_r.share", "_r.rank", "_lo", "_hi")
    done = []
    while True:
        done.append(found.filter("_lo = _hi").select(*keys, "share", F.col("_lo").alias("_value")))
        wide = found.filter("_lo < _hi")
        n = wide.count()
        if not n:
            break
        wide = F.broadcast(wide) if n <= BROADCAST_RANGES else wide
        # halves, so that the width of no range overflows; the bucket of a value never falls as the value grows
        at = F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * buckets), F.lit(buckets - 1))
        counts = rows.join(wide, keys).filter("_v between _lo and _hi").groupBy(*keys, "share", "rank", at.alias("bucket")).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        group = Window.partitionBy(*keys, "share").orderBy("bucket")
        counts = counts.withColumn("_up", F.sum("n").over(group)).filter("_up >= rank and _up - n < rank")
        found = stored(counts.select(*keys, "share", (F.col("rank") - F.col("_up") + F.col("n")).alias("rank"), "_lo", "_hi"), "ranges")
    values = done[0]
    for d in done[1:]:
        values = values.unionByName(d)
    wide = values.groupBy(*keys).agg(*(F.max(F.when(F.col("share") == name, F.col("_value"))).alias(name) for name in shares))
    out = stored(sizes.select(*keys, "n").join(wide, keys), "ranks")
    discard(rows)
    return out.select(*(F.col(k).getField(b).alias(b) for b, k in zip(by, keys)), "n", *shares)
