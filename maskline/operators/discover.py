"""Discovery of sensitive data: which rows, columns and places of a corpus hold what."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskline.functions import patterns as P
from maskline.functions import scalars as S
from maskline.functions import scan as X
from maskline.plans.session import ship

FINDING = X.FINDING


def with_findings(df: DataFrame, text: str, patterns: list[P.Pattern], least: int, out: str = "findings", normalize: bool = False, keep: Callable | None = None, claims: bool = False) -> DataFrame:
    """df with an array of all findings of the patterns, in their order; start counts code points from 0. Null text: none.

    keep: which of them count; claims: less those that overlap an earlier one. A task looks through each text once (functions.scan)."""
    ship(df.sparkSession)
    return df.withColumn(out, X.found(F.col(text), patterns, least, normalize, keep, claims))


def exploded(df: DataFrame, keys: list[str], col: str = "findings") -> DataFrame:
    # the outer form: for the inner one the optimizer adds a filter on the array's size, which computes the array again
    return df.select(*keys, F.inline_outer(col)).filter("kind is not null")


def scan_pii(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row for each hit of the screen patterns: keys, kind, value (as written), start, length; earlier patterns claim first.

    Digits of other scripts match like ASCII ones. Values shorter than 4, and what only looks like a phone, card or labelled value, claim nothing.
    """
    df = with_findings(df, text, P.SCREEN, 4, normalize=True, keep=X.looks_right, claims=True)
    return df.select(*keys, F.col(text).alias("_text"), F.inline_outer("findings")).filter("kind is not null").select(*keys, "rank", "kind", F.substr("_text", F.col("start") + 1, F.col("length")).alias("value"), "start", "length")


def scan_secrets(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Credentials, 8 characters at least: keys and the columns of a finding."""
    return exploded(with_findings(df, text, P.SECRETS, 8), keys)


def scan_personal(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Personal and financial data, 3 characters at least."""
    return exploded(with_findings(df, text, P.PERSONAL, 3), keys)


def scan_values(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Credentials and personal data, as scan_secrets() and scan_personal() have them, in one pass over the texts."""
    return exploded(with_findings(df, text, P.SECRETS + P.PERSONAL, 3, keep=X.long_secrets), keys)


def scan_checksummed(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Hits with checksum_valid: cards only if Luhn holds, 12-digit numbers with the outcome of Verhoeff, others null."""
    rows = exploded(with_findings(df, text, P.CHECKED, 1), keys)
    valid = F.when(F.col("kind") == "AADHAAR", S.verhoeff_valid("value")).when(F.col("kind") == "CREDIT_CARD", S.luhn_valid("value"))
    return rows.withColumn("checksum_valid", valid).filter("kind <> 'CREDIT_CARD' or checksum_valid")


FLAGS = [P.EMAIL, P.PHONE, P.CARD, P.SSN, P.VID, P.AADHAAR, P.PAN, P.LICENCE, P.VEHICLE, P.PASSPORT, P.IFSC, P.GSTIN]
NO_CASE_FLAGS = [P.ACCOUNT, P.UPI, P.EMPLOYEE]


def keyword_regex() -> str:
    return P.java(r"\b(?:" + "|".join(k.replace("-", r"\-") for k in P.KEYWORDS) + r")\b")


def has_pii(df: DataFrame, text: str = "text", out: str = "has_pii") -> DataFrame:
    """df with a flag: not a caption of the application, and a pattern, a sensitive label with a value, or a named person."""
    t = F.coalesce(F.col(text), F.lit(""))
    ship(df.sparkSession)
    flags = [P.Pattern("flag", "FLAG", "pii", p) for p in FLAGS] + [P.Pattern("flag", "FLAG", "pii", p, ignore_case=True) for p in NO_CASE_FLAGS]
    names = [P.Pattern("name", "NAME", "pii", P.ROLE_NAME), P.Pattern("name", "NAME", "pii", P.NAME_WITH_ID)]
    df = df.withColumn("_hit", X.any_hit(F.col(text), flags, names))
    hit = F.col("_hit") | F.exists(X.pairs(F.col(text)), lambda x: S.keyword_form(x["label"]).rlike(keyword_regex()))
    return df.withColumn(out, hit & ~S.is_app_chrome(t)).drop("_hit")


def scan_text_ranges(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, kind, value, start, length of every occurrence, overlapping or not: the patterns of a page's text, names after
    roles and before numbers (3 characters at least), and values of sensitive labels (kind: the label, 30 characters at most)."""
    df = df.select(*keys, F.col(text).alias("_text"))
    hits = exploded(with_findings(df, "_text", P.TEXT_RANGES, 3, keep=X.looks_right), keys).select(*keys, "kind", "value", "start", "length")
    named = _key_values(df, keys, "_text").select(*keys, F.left(F.lower("label"), F.lit(30)).alias("kind"), "value", "start", F.length("value").alias("length"))
    return hits.unionByName(named)


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{P.WHITE}]+|[{P.WHITE}]+$", "")


def _key_values(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, label, value, start of `label: value` pairs, at a line's or part's start, whose label is sensitive."""
    ship(df.sparkSession)
    rows = df.select(*keys, F.explode(X.pairs(F.col(text))).alias("p"))
    rows = rows.select(*keys, _trim(F.col("p")["label"]).alias("label"), _trim(F.col("p")["value"]).alias("value"), F.col("p")["start"].alias("start"))
    return rows.filter((F.length("label") > 0) & (F.length("value") >= 2) & S.keyword_form("label").rlike(keyword_regex()))


def scan_key_values(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, label, value of `label: value` pairs whose label is sensitive; parts end at line ends, `|` and `;`."""
    return _key_values(df, keys, text).select(*keys, "label", "value")


def sensitive_columns(df: DataFrame) -> DataFrame:
    """column, type, sensitive: by the words of the column's name."""
    rows = df.sparkSession.createDataFrame(df.dtypes, "column string, type string")
    return rows.withColumn("sensitive", S.keyword_form("column").rlike(keyword_regex()))


def context_pii(df: DataFrame, key: str) -> DataFrame:
    """key, column, value of the cells (2 characters at least) whose column's name is sensitive."""
    names = [c for c in df.columns if c != key]
    cells = df.select(F.col(key), *(F.col(c).cast("string").alias(c) for c in names)).unpivot([key], names, "column", "value")
    marked = F.broadcast(sensitive_columns(df).filter("sensitive").select("column"))  # as many rows as df has columns
    return cells.join(marked, "column").filter(F.length("value") >= 2).select(key, "column", "value")


def severity(label: S.ColumnLike) -> Column:
    """Struct of severity and confidence; the first rule that fits decides."""
    x, out = F.lower(F.trim(S.col(label))), F
    for words, name, confidence in _severity_order():
        out = out.when(x.rlike(P.java(words)), F.struct(F.lit(name).alias("severity"), F.lit(confidence).alias("confidence")))
    return out.otherwise(F.struct(F.lit("CONTEXTUAL").alias("severity"), F.lit(0.76).alias("confidence")))


def _severity_order():
    return P.SEVERITIES


def severity_profile(findings: DataFrame, label: str = "kind") -> DataFrame:
    s = severity(label)
    return findings.withColumn("severity", s["severity"]).withColumn("confidence", s["confidence"])


def scan_prompt_injection(df: DataFrame, text: str = "text") -> DataFrame:
    """df with matches (names of attacks), is_injection and risk."""
    t = F.coalesce(F.col(text), F.lit(""))
    matches = F.array_compact(F.array(*(F.when(t.rlike(P.java(p, True)), F.lit(name)) for name, p in P.INJECTIONS)))
    df = df.withColumn("matches", matches).withColumn("is_injection", F.size("matches") > 0)
    high = (F.size("matches") >= 2) | F.arrays_overlap("matches", F.array(F.lit("override_rules"), F.lit("credential_exfil")))
    return df.withColumn("risk", F.when(~F.col("is_injection"), "none").when(high, "high").otherwise("medium"))


def discovery_summary(findings: DataFrame, by: list[str]) -> DataFrame:
    """Findings, different values and credentials for each combination of by, its subtotals and the total (rollup)."""
    return findings.rollup(*by).agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"), F.count_if(F.col("category") == "secret").alias("n_secrets"))


def adjacent_label_pii(elements: DataFrame) -> DataFrame:
    """Elements whose text follows a short sensitive label on the same page: page_id, ord, label, text."""
    w = Window.partitionBy("page_id").orderBy("ord")
    rows = elements.filter("text is not null and text <> ''").withColumn("label", F.lag("text").over(w))
    words = F.size(F.split(F.trim("label"), r"\s+"))
    short = (F.length("label") <= 60) & ((words <= 3) | F.col("label").contains(":"))
    own = S.keyword_form("text").rlike(keyword_regex()) & (F.size(F.split(F.trim("text"), r"\s+")) <= 3)
    return rows.filter(short & S.keyword_form("label").rlike(keyword_regex()) & F.length("text").between(2, 120) & ~own & ~S.is_app_chrome("label")).select("page_id", "ord", "label", "text")


INPUT_NAMES = "ssn card password passwd email phone mobile aadhaar dob birth address zip postal name cvv pan ifsc passport account".split()
INPUT_PLACEHOLDERS = "email phone password name aadhaar".split()


def sensitive_inputs(elements: DataFrame) -> DataFrame:
    """Form fields that hold personal data by type, autocomplete, name or placeholder; search boxes don't."""
    tag, kind = F.lower("tag"), F.lower(F.coalesce("input_type", F.lit("")))
    name, auto, hint = (F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "autocomplete", "placeholder"))
    by_type = kind.isin("password", "email", "tel")
    by_auto = auto.contains("cc-") | auto.contains("tel") | auto.isin("email", "name", "street-address", "postal-code")
    field = (tag == "input") & (by_type | by_auto | name.rlike("|".join(INPUT_NAMES)) | hint.rlike("|".join(INPUT_PLACEHOLDERS)))
    area = (tag == "textarea") & (name.rlike("address|about") | (auto == "street-address") | hint.contains("address"))
    search = (kind == "search") | name.rlike("search|query") | hint.contains("search")
    return elements.filter((field | area) & ~search)
