"""Where queries and their SQL counterparts are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: White space of the patterns, and a pattern of theirs as RE2 has it.
RE2_WHITE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def re2(pattern: str) -> str:
    """The pattern with white space as wide as in Spark's form of it; for patterns without look-around."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\":
            out.append({"\\s": RE2_WHITE if inside else f"[{RE2_WHITE}]", "\\S": f"[^{RE2_WHITE}]"}.get(two, two))
            i += 2
            continue
        inside = (inside or two[0] == "[") and two[0] != "]"
        out.append(two[0])
        i += 1
    return "".join(out)


def walk_sql(rows: str, group: str, order: str, state: str, step: str, bound: str = "") -> str:
    """CTEs b (rows, with i: their place in the group) and s (group, i, kept, taken): one row of each group after the other, kept being a list
    of `state` structs. step: the new kept and taken, from b's columns and kept."""
    return f"""b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS i FROM {rows} {bound}),
s AS (SELECT {group}, 0::BIGINT AS i, []::{state}[] AS kept, false AS taken FROM (SELECT DISTINCT {group} FROM b) UNION ALL SELECT {group}, i, {step} FROM (SELECT b.*, s.kept FROM s JOIN b ON b.{group} = s.{group} AND b.i = s.i + 1))"""


def greedy_sql(rows: str, group: str, order: str, fields: dict[str, str], clash: str, bound: str = "") -> str:
    """walk_sql where a row is taken unless it clashes with one that is kept (k)."""
    own = "{" + ", ".join(f"'{c}': {c}" for c in fields) + "}"
    free = f"len(list_filter(kept, lambda k: {clash})) = 0"
    state = "STRUCT(" + ", ".join(f"{c} {t}" for c, t in fields.items()) + ")"
    return walk_sql(rows, group, order, state, f"CASE WHEN {free} THEN list_append(kept, {own}) ELSE kept END, {free}", bound)
