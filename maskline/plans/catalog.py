"""The registered queries and their SQL counterparts. Each works on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskline.functions import patterns as P
from maskline.functions.scalars import flat
from maskline.operators import discover, egress, facets, images, quality, redact, regions, runs
from maskline.plans.registry import ORACLES, QUERIES, RE2_WHITE, greedy_sql, query, re2, sql_text, table, walk_sql
from maskline.sources import io
from maskline.sources.tables import spread, stored

__all__ = ["ORACLES", "QUERIES", "flagship"]


# --- text: documents with planted values, so that kinds which the tables lack meet an oracle too ---


def planted(spark: SparkSession, d: str) -> DataFrame:
    """documents with a suffix made of doc_id: an email, a PAN, an IFSC, a 4-4-4 number; for every tenth a key."""
    n = F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0")
    key = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit(" AKIA"), F.lpad(F.col("doc_id").cast("string"), 16, "0"))).otherwise("")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\nmail user"), n, F.lit("@example.org pan ABCDE"), n, F.lit("F ifsc HDFC000"), n, F.lit(" id 2345 6789 "), n, key)
    return spread(table(spark, d, "documents")).withColumn("text", text)


PLANTED = "(SELECT doc_id, source, lang, coalesce(text, '') || chr(10) || 'mail user' || n || '@example.org pan ABCDE' || n || 'F ifsc HDFC000' || n || ' id 2345 6789 ' || n || CASE WHEN doc_id % 10 = 0 THEN ' AKIA' || lpad(doc_id::VARCHAR, 16, '0') ELSE '' END AS text FROM (SELECT *, lpad((doc_id % 10000)::VARCHAR, 4, '0') AS n FROM documents))"


def findings_sql(patterns: list[P.Pattern], source: str, least: int) -> str:
    """All values of the patterns, as SQL; for patterns without look-around."""
    parts = [f"SELECT doc_id, source, {sql_text(p.kind)} AS kind, {sql_text(p.category)} AS category, unnest(regexp_extract_all(text, {sql_text(p.regex)}, {p.group}, '{'i' if p.ignore_case else 'c'}')) AS value FROM {source}" for p in patterns]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE length(value) >= {least}"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return personal_by_source(spark, d)


#: What the SQL looks for: RE2 has no look-ahead for the other one, so tests/test_discover.py checks that kind.
PLAIN_SECRETS = [p for p in P.SECRETS if p.kind != "openai_key"]


@query(f"WITH f AS ({findings_sql(P.PERSONAL, PLANTED, 3)}) SELECT source, kind, count(*) AS n, count(DISTINCT value) AS n_values FROM f GROUP BY ALL")
def personal_by_source(spark, d):
    return discover.scan_personal(planted(spark, d), ["doc_id", "source"]).groupBy("source", "kind").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


@query(f"WITH f AS ({findings_sql(PLAIN_SECRETS, PLANTED, 8)}) SELECT doc_id, kind, value FROM f")
def secrets_found(spark, d):
    return discover.scan_secrets(planted(spark, d), ["doc_id"]).select("doc_id", "kind", "value")


LUHN_SQL = "(length(v) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(v)), lambda i: CASE WHEN i % 2 = 0 THEN v[length(v) - i]::INT WHEN v[length(v) - i]::INT > 4 THEN v[length(v) - i]::INT * 2 - 9 ELSE v[length(v) - i]::INT * 2 END)) % 10 = 0)"
VERHOEFF_SQL = f"(length(v) >= 2 AND list_reduce(list_prepend(0, list_transform(range(length(v)), lambda i: (i % 8 * 10 + v[length(v) - i]::INT)::BIGINT)), lambda a, x: (('{flat(P.VERHOEFF_D)}')[(a * 10 + ('{flat(P.VERHOEFF_P)}')[(x + 1)::BIGINT]::BIGINT + 1)::BIGINT])::BIGINT) = 0)"


@query(f"WITH f AS ({findings_sql(P.CHECKED, PLANTED, 1)}), g AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS v FROM f), h AS (SELECT doc_id, kind, value, CASE WHEN kind = 'AADHAAR' THEN {VERHOEFF_SQL} WHEN kind = 'CREDIT_CARD' THEN {LUHN_SQL} END AS checksum_valid FROM g) SELECT * FROM h WHERE kind <> 'CREDIT_CARD' OR checksum_valid")
def checksummed(spark, d):
    return discover.scan_checksummed(planted(spark, d), ["doc_id"]).select("doc_id", "kind", "value", "checksum_valid")


def has(text: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({text}, {sql_text(re2(pattern))}{", 'i'" if ignore_case else ''})"


def keyword_sql(label: str) -> str:
    words = f"lower(trim(regexp_replace(regexp_replace(regexp_replace({label}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-.]+', ' ', 'g'), '[{RE2_WHITE}]+', ' ', 'g')))"
    return has(words, r"\b(?:" + "|".join(k.replace("-", r"\-") for k in P.KEYWORDS) + r")\b")


#: Whether a text holds a phone number: what may not stand around one is consumed, as RE2 has no look-around.
PHONE_SOMEWHERE = r"(?:^|[^\d.₹$€£¥,])\+?\d[\d\s\-().]{7,}\d(?:[^\d%]|$)"
DIGITS_SQL = "translate(t, '" + "".join(chr(ord(b) + i) for b in P.DIGIT_BLOCKS for i in range(10)) + "', '" + "0123456789" * len(P.DIGIT_BLOCKS) + "')"
CHROME_SQL = f"lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}\\x{{200E}}\\x{{200F}}\\x{{00A0}}\\x{{202A}}-\\x{{202E}}]', ' ', 'g'), '[•·|—–-]+', ' ', 'g'), '[{RE2_WHITE}]+', ' ', 'g')))"
FLAGS_SQL = " OR ".join([*(has("d", PHONE_SOMEWHERE if p == P.PHONE else p) for p in discover.FLAGS), *(has("d", p, True) for p in discover.NO_CASE_FLAGS), has("t", P.ROLE_NAME), has("t", P.NAME_WITH_ID)])
LABELS_SQL = f"regexp_extract_all(t, {sql_text(re2(P.KEY_VALUE))}, 1)"
CAPTIONS_SQL = ", ".join(sql_text(x) for x in P.CHROME)
TRIM_SQL = f"'^[{RE2_WHITE}]+|[{RE2_WHITE}]+$', '', 'g'"

#: A phone number with what may not stand around it consumed; room_sql() parts numbers that follow each other by a mark.
PHONE_PARTS = r"(^|[^\d.₹$€£¥,])(\+?\d[\d\s\-().]{7,}\d)([^\d%]|$)"


def room_sql(text: str) -> str:
    other = re2(r"[^\d\s\-().+%₹$€£¥,]")
    return f"regexp_replace(regexp_replace({text}, '{re2(r'([\s()-])')}\\+', '\\1' || chr(3) || '+', 'g'), '{other}', '\\0' || chr(3), 'g')"


def places_sql(patterns: list[P.Pattern], rows: str, least: int) -> str:
    """doc_id, rank, kind, value, start, length of all hits in t: the pieces between marks are text and hit in turn."""
    parts = []
    for rank, p in enumerate(patterns):
        phone = p.regex == P.PHONE
        regex, text = (PHONE_PARTS, room_sql("t")) if phone else (p.regex, "t")
        marked = "'\\1' || chr(1) || '\\2' || chr(2) || '\\2' || chr(1) || '\\3'" if phone else f"chr(1) || '\\0' || chr(2) || '\\{p.group}' || chr(1)"
        flags = "'gi'" if p.ignore_case else "'g'"
        parts.append(f"SELECT doc_id, {rank} AS rank, {sql_text(p.kind)} AS kind, {p.group if not phone else 0} AS part, string_split(regexp_replace({text}, {sql_text(re2(regex))}, {marked}, {flags}), chr(1)) AS pieces FROM {rows} WHERE {has(text, regex, p.ignore_case)}")
    return f"""(SELECT doc_id, rank, kind, value, before + CASE WHEN part > 0 THEN greatest(strpos(hit, value) - 1, 0) ELSE 0 END AS start, length(value) AS length FROM (
SELECT *, split_part(piece, chr(2), 1) AS hit, CASE WHEN contains(piece, chr(2)) THEN split_part(piece, chr(2), 2) ELSE piece END AS value, coalesce(sum(length(split_part(piece, chr(2), 1))) OVER (PARTITION BY doc_id, rank ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
FROM (SELECT doc_id, rank, kind, part, unnest(list_transform(pieces, lambda x: replace(x, chr(3), ''))) AS piece, generate_subscripts(pieces, 1) AS j FROM ({" UNION ALL ".join(parts)}))) WHERE j % 2 = 0 AND length(value) >= {least})"""


LOOSE_SQL = "(contains(value, '.') OR regexp_matches(value, '[a-zA-Z]'))"
GUARD_SQL = f"""NOT CASE kind WHEN 'phone' THEN {LOOSE_SQL} OR length(regexp_replace(value, '[^0-9]', '', 'g')) < 9 WHEN 'card' THEN {LOOSE_SQL} OR length(regexp_replace(value, '[^0-9]', '', 'g')) < 13
WHEN 'labelled_value' THEN len(regexp_split_to_array(trim(value), '[{RE2_WHITE}]+')) > 4 OR regexp_matches(trim(value), '[.?!]$') OR {has("trim(value)", P.NOT_A_VALUE, True)} ELSE false END"""
CLAIMS_SQL = greedy_sql(f"(SELECT * FROM {places_sql(P.SCREEN, 'texts', 4)} WHERE {GUARD_SQL})", "doc_id", "rank, start", {"start": "BIGINT", "length": "BIGINT"}, "greatest(k.start, start) < least(k.start + k.length, start + length)")


@query(f"WITH RECURSIVE whole AS MATERIALIZED (SELECT doc_id, text AS t FROM {PLANTED}), texts AS MATERIALIZED (SELECT doc_id, {DIGITS_SQL} AS t FROM whole), {CLAIMS_SQL} SELECT doc_id, kind, substr(t, start + 1, length) AS value, start, length FROM b JOIN s USING (doc_id, i) JOIN whole USING (doc_id) WHERE taken")
def screen_findings(spark, d):
    return discover.scan_pii(planted(spark, d), ["doc_id"]).select("doc_id", "kind", "value", "start", "length")


PAIRS_IN_TEXT = places_sql([P.Pattern("labelled_value", "LABELLED_VALUE", "pii", P.KEY_VALUE, 2)], "texts", 1)


@query(f"""WITH texts AS MATERIALIZED (SELECT doc_id, text AS t FROM {PLANTED}), l AS (SELECT doc_id, unnest(x) AS l, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, {LABELS_SQL} AS x FROM texts)),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS i FROM {PAIRS_IN_TEXT}), n AS (SELECT doc_id, regexp_replace(l, {TRIM_SQL}) AS label, regexp_replace(value, {TRIM_SQL}) AS value, start FROM l JOIN v USING (doc_id, i))
SELECT doc_id, kind, value, start, length FROM {places_sql(P.TEXT_RANGES, 'texts', 3)} WHERE {GUARD_SQL} UNION ALL SELECT doc_id, left(lower(label), 30), value, start, length(value) FROM n WHERE length(label) > 0 AND length(value) >= 2 AND {keyword_sql('label')}""")
def text_ranges(spark, d):
    return discover.scan_text_ranges(planted(spark, d), ["doc_id"])


@query(f"""WITH p AS (SELECT source, coalesce(text, '') AS t, {CHROME_SQL} AS c FROM documents), q AS (SELECT *, {DIGITS_SQL} AS d FROM p),
f AS (SELECT source, NOT coalesce(c IN ({CAPTIONS_SQL}) OR regexp_matches(c, '^\\d+ unread(?: messages?)?$') OR starts_with(c, 'not a contact'), false) AND ({FLAGS_SQL} OR len(list_filter({LABELS_SQL}, lambda x: {keyword_sql('x')})) > 0) AS has_pii FROM q)
SELECT source, has_pii, count(*) AS n FROM f GROUP BY ALL""")
def flagged_documents(spark, d):
    return discover.has_pii(spread(table(spark, d, "documents"))).groupBy("source", "has_pii").agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, unnest({LABELS_SQL}) AS l, unnest(regexp_extract_all(t, {sql_text(re2(P.KEY_VALUE))}, 2)) AS v FROM p),
g AS (SELECT doc_id, regexp_replace(l, {TRIM_SQL}) AS label, regexp_replace(v, {TRIM_SQL}) AS value FROM f) SELECT * FROM g WHERE length(label) > 0 AND length(value) >= 2 AND {keyword_sql('label')}""")
def key_values(spark, d):
    return discover.scan_key_values(table(spark, d, "documents"), ["doc_id"])


@query("SELECT c_custkey, 'c_name' AS \"column\", c_name AS value FROM customer WHERE length(c_name) >= 2")
def context_cells(spark, d):
    return discover.context_pii(table(spark, d, "customer"), "c_custkey")


SEVERITY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(kind), {sql_text(w)}) THEN {sql_text(s)}" for w, s, _ in P.SEVERITIES) + " ELSE 'CONTEXTUAL' END"


@query(f"WITH f AS ({findings_sql(P.PERSONAL, PLANTED, 3)}) SELECT {SEVERITY_SQL} AS severity, count(*) AS n FROM f GROUP BY ALL")
def severities(spark, d):
    return discover.severity_profile(discover.scan_personal(planted(spark, d), ["doc_id"])).groupBy("severity").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT conv_id, turn, " + ", ".join(f"regexp_matches(coalesce(text, ''), {sql_text(p)}, 'i') AS {n}" for n, p in P.INJECTIONS) + " FROM conversations), m AS (SELECT conv_id, turn, " + " + ".join(f"{n}::INT" for n, _ in P.INJECTIONS) + " AS n, override_rules OR credential_exfil AS bad FROM t) SELECT conv_id, turn, n AS n_matches, CASE WHEN n = 0 THEN 'none' WHEN n >= 2 OR bad THEN 'high' ELSE 'medium' END AS risk FROM m")
def prompt_injections(spark, d):
    return discover.scan_prompt_injection(table(spark, d, "conversations")).select("conv_id", "turn", F.size("matches").alias("n_matches"), "risk")


@query(f"WITH f AS ({findings_sql(P.PERSONAL, PLANTED, 3)} UNION ALL {findings_sql(PLAIN_SECRETS, PLANTED, 8)}) SELECT source, kind, count(*) AS n, count(DISTINCT value) AS n_values, count(*) FILTER (WHERE category = 'secret') AS n_secrets FROM f GROUP BY ROLLUP (source, kind)")
def discovery_summary(spark, d):
    rows = discover.scan_values(planted(spark, d), ["source"])
    return discover.discovery_summary(rows, ["source", "kind"])


@query(f"WITH f AS ({findings_sql(P.PERSONAL, PLANTED, 3)} UNION ALL {findings_sql(PLAIN_SECRETS, PLANTED, 8)}) SELECT doc_id, kind, CASE WHEN category = 'secret' THEN value[1:4] || '...' || right(value, 3) WHEN length(value) <= 4 THEN '***' ELSE value[1:3] || '***' || right(value, 2) END AS preview, count(*) AS n FROM f GROUP BY ALL")
def masked_previews(spark, d):
    rows = discover.scan_values(planted(spark, d), ["doc_id"])
    return rows.groupBy("doc_id", "kind", redact.masked(F.col("value"), F.col("category")).alias("preview")).agg(F.count("*").alias("n"))


SCRUBBED = PLAIN_SECRETS + P.PERSONAL
NAMES_SQL = "[" + ", ".join(sql_text(p.token) for p in SCRUBBED) + "]"
#: texts, the findings that claim their places (f), and a token for each different value (u).
TOKENS_SQL = f"""WITH RECURSIVE texts AS MATERIALIZED (SELECT doc_id, text AS t FROM {PLANTED}),
{greedy_sql(f"(SELECT * FROM {places_sql(SCRUBBED, 'texts', 3)} WHERE rank >= {len(PLAIN_SECRETS)} OR length >= 8)", "doc_id", "rank, start", {"start": "BIGINT", "length": "BIGINT"}, "greatest(k.start, start) < least(k.start + k.length, start + length)")},
f AS MATERIALIZED (SELECT doc_id, i, value, rank < {len(PLAIN_SECRETS)} AS secret, {NAMES_SQL}[rank + 1] AS name FROM b JOIN s USING (doc_id, i) WHERE taken),
u AS MATERIALIZED (SELECT doc_id, value, '[' || name || '_' || row_number() OVER (PARTITION BY doc_id, name ORDER BY first) || ']' AS token FROM (SELECT doc_id, name, value, min(i) AS first FROM f GROUP BY ALL))"""


@query(f"""{TOKENS_SQL}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(value) DESC, token, value) AS n FROM u),
w AS (SELECT doc_id, 0::BIGINT AS n, t FROM texts UNION ALL SELECT w.doc_id, o.n, replace(w.t, o.value, o.token) FROM w JOIN o ON o.doc_id = w.doc_id AND o.n = w.n + 1)
SELECT doc_id, arg_max(t, n) AS clean_text, coalesce(any_value(n_secrets), 0) AS n_secrets, coalesce(any_value(n_pii), 0) AS n_pii FROM w LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE secret) AS n_secrets, count(*) FILTER (WHERE NOT secret) AS n_pii FROM f GROUP BY ALL) USING (doc_id) GROUP BY doc_id""")
def scrubbed_documents(spark, d):
    return redact.scrub(planted(spark, d), "doc_id").drop("tokens")


@query(f"{TOKENS_SQL} SELECT doc_id, token, value FROM u")
def token_table(spark, d):
    return redact.redact_documents(planted(spark, d))[1]


@query("SELECT doc_id, text FROM " + PLANTED)
def scrub_round_trip(spark, d):
    """Scrubbed and restored: the text as it was."""
    out = stored(redact.scrub(planted(spark, d), "doc_id"), "scrubbed")  # read three times
    return redact.unmask(out.select("doc_id", F.col("clean_text").alias("text")), "doc_id", "text", out.select("doc_id", F.inline_outer("tokens")).filter("token is not null"))


def planted_turns(spark: SparkSession, d: str) -> DataFrame:
    n = F.lpad((F.col("conv_id") % 100).cast("string"), 4, "0")
    return table(spark, d, "conversations").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" mail c"), n, F.lit("@example.org")))


@query("SELECT conv_id, turn, coalesce(text, '') || ' mail [EMAIL_1]' AS clean_text FROM conversations")
def scrubbed_conversations(spark, d):
    return redact.scrub_in_scope(planted_turns(spark, d), "conv_id", "turn")[0].select("conv_id", "turn", "clean_text")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def encryption_round_trip(spark, d):
    key = F.lit("0123456789abcdef0123456789abcdef").cast("binary")
    df = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return redact.decrypt_columns(redact.encrypt_columns(df, ["c_name", "c_mktsegment"], key), ["c_name", "c_mktsegment"], key)


@query("WITH v AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg FROM customer), s AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'Name' WHEN 1 THEN 'market segment' WHEN 2 THEN 'segment' ELSE 'shoe size' END AS symbol FROM customer) SELECT k AS c_custkey, symbol, CASE symbol WHEN 'Name' THEN name WHEN 'shoe size' THEN '' ELSE seg END AS value FROM s JOIN v USING (k)")
def resolved_symbols(spark, d):
    c = table(spark, d, "customer")
    m = F.col("c_custkey") % 4
    asked = c.select("c_custkey", F.when(m == 0, "Name").when(m == 1, "market segment").when(m == 2, "segment").otherwise("shoe size").alias("symbol"))
    vault = c.select("c_custkey", F.inline(F.array(F.struct(F.lit("name").alias("name"), F.col("c_name").alias("value")), F.struct(F.lit("segment").alias("name"), F.col("c_mktsegment").alias("value")))))
    aliases = spark.createDataFrame([("market_segment", "segment")], "alias string, name string")
    return redact.resolve_symbols(asked, "c_custkey", "symbol", vault, aliases).select("c_custkey", "symbol", "value")


# --- egress ---


def payloads(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents")
    return df.select(F.col("doc_id"), (F.col("doc_id") % 4).cast("int").alias("budget_level"), F.when(F.col("doc_id") % 3 == 0, "img").alias("image"), (F.col("doc_id") % 2 == 0).alias("redaction_verified"), F.col("text").alias("data"))


CARDS_SQL = "list_transform(regexp_extract_all(t, '" + P.CARD + "'), lambda x: regexp_replace(x, '[^0-9]', '', 'g'))"
IDS_SQL = "list_transform(regexp_extract_all(t, '" + P.AADHAAR + "'), lambda x: regexp_replace(x, '[^0-9]', '', 'g'))"


@query(
    f"""WITH p AS (SELECT doc_id, doc_id % 4 AS l, CASE WHEN doc_id % 3 = 0 THEN 'img' END AS image, doc_id % 2 = 0 AS ok, coalesce(text, '') AS t FROM documents),
c AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({CARDS_SQL}) AS v FROM p) WHERE {LUHN_SQL}), i AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({IDS_SQL}) AS v FROM p) WHERE {VERHOEFF_SQL}),
q AS (SELECT *, coalesce(length(image) > 0 AND l > 0, false) AS has FROM p)
SELECT doc_id, (octet_length(encode(t)) + CASE WHEN l > 0 THEN coalesce(length(image), 0) ELSE 0 END)::BIGINT AS bytes,
CASE WHEN trim(t) = '' AND NOT has THEN 'empty payload' WHEN has AND NOT ok THEN 'image without verified redaction' WHEN doc_id IN (FROM c) THEN 'card number' WHEN doc_id IN (FROM i) THEN 'identity number' END AS block_reason FROM q"""
)
def gated_payloads(spark, d):
    return egress.egress_gate(payloads(spark, d)).select("doc_id", "bytes", "block_reason")


@query(f"SELECT CASE WHEN regexp_matches(lower(coalesce(text, '')), {sql_text('|'.join(P.VISUAL))}) THEN 3 ELSE 0 END AS level, count(*) AS n FROM conversations GROUP BY ALL")
def disclosure_tiers(spark, d):
    return egress.disclosure_tier(table(spark, d, "conversations")).groupBy("level").agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_extract(url, '^([^?#]*)', 1) ELSE string_split(url, '?')[1] END AS url FROM pages")
def safe_urls(spark, d):
    return table(spark, d, "pages").select("page_id", egress.safe_url("url").alias("url"))


def leak_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Turns that quote the account number of their conversation's number (of a customer, or of none), and all customers' accounts."""
    accounts = table(spark, d, "customer").select(F.col("c_custkey").alias("secret_id"), F.concat(F.lit("acct-"), F.lpad((F.col("c_custkey") * 7919 + 10000019).cast("string"), 12, "0")).alias("value"))
    turns = table(spark, d, "conversations").filter("text is not null")
    text = F.concat(F.col("text"), F.lit(" ACCT-"), F.lpad((F.col("conv_id") * 7919 + 10000019).cast("string"), 12, "0"))
    return turns.select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), text.alias("text")), accounts


@query("""WITH v AS (SELECT c_custkey AS secret_id, lpad((c_custkey * 7919 + 10000019)::VARCHAR, 12, '0') AS vd FROM customer),
p AS (SELECT concat_ws(':', conv_id, turn) AS turn_id, lower(text) || ' acct-' || lpad((conv_id * 7919 + 10000019)::VARCHAR, 12, '0') AS t FROM conversations WHERE text IS NOT NULL),
q AS (SELECT turn_id, t, regexp_replace(t, '[^0-9]', '', 'g') AS d FROM p),
b AS (SELECT DISTINCT turn_id, secret_id, 1 AS found FROM q JOIN v ON contains(t, 'acct-' || vd)),
k AS (SELECT secret_id, vd, unnest(range(1, 6)) AS i FROM v),
r AS (SELECT DISTINCT turn_id, d, substr(d, i::BIGINT, 8) AS run FROM (SELECT turn_id, d, unnest(range(1, length(d) - 6)) AS i FROM q)),
m AS (SELECT DISTINCT turn_id, d, secret_id, vd FROM r JOIN k ON run = substr(vd, i::BIGINT, 8)),
g AS (SELECT turn_id, secret_id, max(n) AS digit_run FROM (SELECT turn_id, secret_id, d, vd, a, unnest(range(8, 14 - a)) AS n FROM (SELECT *, unnest(range(1, 6)) AS a FROM m)) WHERE contains(d, substr(vd, a::BIGINT, n::BIGINT)) GROUP BY ALL)
SELECT turn_id, secret_id, found IS NOT NULL AS verbatim, coalesce(digit_run, 0)::INT AS digit_run FROM b FULL JOIN g USING (turn_id, secret_id)""")
def leaks_found(spark, d):
    pay, secrets = leak_rows(spark, d)
    return egress.find_leaks(pay, secrets, "turn_id")


# --- boxes: 32 a scan on average, at any size of the tables ---

BOXES_SQL = """(SELECT l_orderkey // 8 AS scan_id, row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)::INT AS ord,
(l_partkey % 300)::INT AS x, (l_suppkey * 7 % 200)::INT AS y, 20 + l_quantity::INT * 3 AS w, 12 + l_linenumber * 4 AS h, CASE l_returnflag WHEN 'A' THEN 'dom' WHEN 'N' THEN 'vision_ocr' ELSE 'vision_face' END AS source, l_linenumber AS line, l_discount AS disc FROM lineitem)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("scan_id", F.floor(F.col("l_orderkey") / 8))
    order = Window.partitionBy("scan_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    source = F.when(F.col("l_returnflag") == "A", "dom").when(F.col("l_returnflag") == "N", "vision_ocr").otherwise("vision_face")
    return li.select("scan_id", F.row_number().over(order).alias("ord"), (F.col("l_partkey") % 300).cast("int").alias("x"), (F.col("l_suppkey") * 7 % 200).cast("int").alias("y"), (20 + F.col("l_quantity").cast("int") * 3).alias("w"), (12 + F.col("l_linenumber") * 4).alias("h"), source.alias("source"), F.col("l_linenumber").alias("line"), F.col("l_discount").alias("disc"))


#: Boxes are up to 170 pixels wide and lie within 470 x 240: in cells of this size most of them stand once.
BOX_CELL = 256


def truth_and_predictions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = boxes(spark, d)
    return b.filter("line = 1"), b.filter("line > 1")


PAIRS_SQL = f"""WITH b AS MATERIALIZED (SELECT scan_id, ord, x, y, w, h, source, line FROM {BOXES_SQL}), j AS (SELECT a.scan_id, a.ord AS a_id, b.ord AS b_id, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0)::BIGINT * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS shared, a.w * a.h AS aa, b.w * b.h AS ba, b.source FROM b a JOIN b ON a.scan_id = b.scan_id AND a.line = 1 AND b.line > 1)"""


@query(f"{PAIRS_SQL} SELECT scan_id, a_id, b_id, shared, round(shared / (aa + ba - shared), 9) AS iou, round(shared / aa, 9) AS covered FROM j WHERE shared > 0")
def overlapping_boxes(spark, d):
    t, p = truth_and_predictions(spark, d)
    pairs = regions.overlap_pairs(t, p, "scan_id", "ord", "ord", BOX_CELL)
    return pairs.select("scan_id", "a_id", "b_id", "shared", F.round("iou", 9).alias("iou"), F.round("covered", 9).alias("covered"))


WALKED_SQL = f"(SELECT scan_id, ord, x::BIGINT AS x, y::BIGINT AS y, w::BIGINT AS w, h::BIGINT AS h, source, disc AS score, (disc * 10)::DOUBLE AS confidence, line = 7 AS circular FROM {BOXES_SQL})"
SIDES = dict.fromkeys("xywh", "BIGINT")
#: Shared area and IoU of a row's box with that of a kept one.
SHARED_SQL = "(greatest(least({k}.x + {k}.w, x + w) - greatest({k}.x, x), 0) * greatest(least({k}.y + {k}.h, y + h) - greatest({k}.y, y), 0))"
KEPT_SHARED = SHARED_SQL.format(k="k")
KEPT_IOU = f"({KEPT_SHARED} / ({{k}}.w * {{k}}.h + w * h - {KEPT_SHARED}))".format(k="k")
MATCH_SQL = f"""(abs(k.x - x) <= 6 AND abs(k.y - y) <= 6 AND abs(k.w - w) <= 8 AND abs(k.h - h) <= 8) OR {KEPT_IOU} >= 0.5 OR {KEPT_SHARED} > 0.55::DOUBLE * (k.w * k.h) OR {KEPT_SHARED} > 0.55::DOUBLE * (w * h)
OR (k.circular AND ({KEPT_IOU} > 0.10::DOUBLE OR (x + w / 2 BETWEEN k.x - 4 AND k.x + k.w + 4 AND y + h / 2 BETWEEN k.y - 4 AND k.y + k.h + 4)))"""
MERGED_SQL = """{'x': CASE WHEN k.circular THEN k.x ELSE least(k.x, x) END, 'y': CASE WHEN k.circular THEN k.y ELSE least(k.y, y) END, 'w': CASE WHEN k.circular THEN k.w ELSE greatest(k.x + k.w, x + w) - least(k.x, x) END,
'h': CASE WHEN k.circular THEN k.h ELSE greatest(k.y + k.h, y + h) - least(k.y, y) END, 'confidence': greatest(k.confidence, confidence), 'circular': k.circular OR circular, 'sources': CASE WHEN list_contains(k.sources, source) THEN k.sources ELSE list_append(k.sources, source) END, 'ord': k.ord}"""
OWN_SQL = "{'x': x, 'y': y, 'w': w, 'h': h, 'confidence': confidence, 'circular': circular, 'sources': [source], 'ord': ord}"
FIRST_SQL = f"list_position(list_transform(kept, lambda k: {MATCH_SQL}), true)"
RANK_SQL = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in regions.SOURCE_ORDER.items()) + " ELSE 9 END"
MERGE_WALK = walk_sql(
    WALKED_SQL, "scan_id", f"{RANK_SQL}, ord", "STRUCT(x BIGINT, y BIGINT, w BIGINT, h BIGINT, confidence DOUBLE, circular BOOLEAN, sources VARCHAR[], ord INT)",
    f"CASE WHEN coalesce({FIRST_SQL}, 0) = 0 THEN list_append(kept, {OWN_SQL}) ELSE list_transform(kept, lambda k, j: CASE WHEN j = {FIRST_SQL} THEN {MERGED_SQL} ELSE k END) END, true",
)


@query(f"WITH RECURSIVE {MERGE_WALK}, e AS (SELECT scan_id, unnest(arg_max(kept, i)) AS r FROM s GROUP BY scan_id) SELECT scan_id, r.x::INT AS x, r.y::INT AS y, r.w::INT AS w, r.h::INT AS h, r.confidence AS confidence, array_to_string(r.sources, ',') AS sources, r.circular AS circular, r.ord AS ord FROM e")
def merged_regions(spark, d):
    out = regions.merge_regions(boxes(spark, d).withColumn("confidence", F.col("disc") * 10).withColumn("circular", F.col("line") == 7))
    return out.withColumn("sources", F.array_join("sources", ","))


@query(f"WITH RECURSIVE {greedy_sql(WALKED_SQL, 'scan_id', 'score DESC NULLS LAST, ord', SIDES, f'{KEPT_IOU} > 0.3::DOUBLE')} SELECT scan_id, ord, x::INT AS x, y::INT AS y, w::INT AS w, h::INT AS h, score FROM b JOIN s USING (scan_id, i) WHERE taken")
def suppressed_boxes(spark, d):
    return regions.nms(boxes(spark, d).withColumn("score", F.col("disc")))


@query(f"WITH RECURSIVE {greedy_sql(WALKED_SQL, 'scan_id', 'ord', SIDES, 'abs(k.x - x) <= 10 AND abs(k.y - y) <= 10')} SELECT scan_id, ord, x::INT AS x, y::INT AS y, w::INT AS w, h::INT AS h FROM b JOIN s USING (scan_id, i) WHERE taken")
def near_duplicates_dropped(spark, d):
    return regions.dedupe_near(boxes(spark, d), 10)


@query(f"WITH b AS (FROM {BOXES_SQL}), c AS (SELECT scan_id, ord, greatest(x - 50, 0) AS x, greatest(y - 40, 0) AS y, least(x - 50 + w, 200) AS r, least(y - 40 + h, 120) AS u FROM b) SELECT scan_id, ord, x, y, r - x AS w, u - y AS h FROM c WHERE r - x >= 4 AND u - y >= 4")
def clipped_boxes(spark, d):
    b = boxes(spark, d).withColumns({"x": F.col("x") - 50, "y": F.col("y") - 40})
    return regions.clip(b, 200, 120).select("scan_id", "ord", "x", "y", "w", "h")


@query(f"WITH b AS (SELECT *, 2.0 * disc * 10 + 0.1 AS score FROM {BOXES_SQL}) SELECT scan_id, count(*) AS n, sum(round(1.30::DOUBLE * w)::BIGINT * round(1.43::DOUBLE * h)::BIGINT)::BIGINT AS area FROM b WHERE score >= 0.65 AND w / h BETWEEN 0.35 AND 2.2 GROUP BY ALL")
def widened_candidates(spark, d):
    b = boxes(spark, d).withColumn("score", 2.0 * F.col("disc") * 10 + 0.1)
    return regions.filter_candidates(b).groupBy("scan_id").agg(F.count("*").alias("n"), F.sum(F.col("w").cast("long") * F.col("h")).alias("area"))


@query(f"""WITH b AS (SELECT scan_id, ord, x, y, w, h, w / h AS ar, w * h AS area, disc * 500 > 45 AS e45, disc * 500 > 20 AS e20, disc * 500 > 16 AS e16, disc * 10 > 0.6 AS thin, line = 7 AS circular, line = 6 AS arrow, ord % 13 = 0 AS known FROM {BOXES_SQL}),
c AS (SELECT *, CASE WHEN thin AND ar >= 1.5 AND ar <= 4.5 AND area < 40000 THEN 1 WHEN ar >= 0.9 AND ar <= 1.1 AND w >= 60 AND w <= 260 AND e45 THEN 2 WHEN w >= 280 AND h >= 140 AND e20 THEN 3 WHEN known THEN 4 WHEN w >= 360 AND h >= 220 AND ar BETWEEN 1.1 AND 2.2 THEN 4
WHEN ar >= 0.8 AND ar <= 1.25 AND w >= 36 AND w <= 200 AND e16 THEN 5 WHEN circular AND w BETWEEN 10 AND 32 THEN 6 WHEN NOT circular AND ar >= 0.85 AND ar <= 1.15 AND w BETWEEN 12 AND 28 AND h BETWEEN 12 AND 28 THEN 7
WHEN arrow AND ar >= 2.2 AND ar <= 8 AND h BETWEEN 22 AND 55 THEN 8 WHEN ar >= 1.4 AND ar <= 5.5 AND h BETWEEN 24 AND 60 AND w <= 260 THEN 9 WHEN ar >= 2.8 AND ar <= 12 AND h BETWEEN 24 AND 55 THEN 10 WHEN ar >= 1.2 AND h BETWEEN 12 AND 24 THEN 11 END AS k FROM b)
SELECT scan_id, ord, ['signature', 'qr_code', 'canvas_chart', 'modal', 'avatar', 'radio', 'checkbox', 'dropdown', 'button', 'input', 'link'][k] AS class, [0.91, 0.95, 0.89, 0.93, 0.92, 0.93, 0.94, 0.88, 0.9, 0.87, 0.81][k]::DOUBLE AS confidence,
['high_dispersion_stroke_contour', 'bicolor_matrix_density', 'multivariate_graph_canvas', 'elevated_container_hierarchy', 'biometric_portrait_geometry', 'concentric_circular_glyph', 'orthogonal_glyph_box', 'chevron_delimited_field', 'rounded_action_rectangle', 'horizontal_entry_strip', 'inline_textual_anchor'][k] AS reason,
round(x / 400, 4) AS share_x, round(h / 300, 4) AS share_h, k >= 6 AS interactive FROM c WHERE k IS NOT NULL""")
def classed_regions(spark, d):
    b = boxes(spark, d).withColumns({"energy": F.col("disc") * 500, "dispersion": F.col("disc") * 10, "circular": F.col("line") == 7, "arrow": F.col("line") == 6, "is_modal": F.col("ord") % 13 == 0})
    return regions.classify_regions(b, viewport=(400, 300)).select("scan_id", "ord", "class", "confidence", "reason", F.col("box.x").alias("share_x"), F.col("box.h").alias("share_h"), "interactive")


CLASS_SQL = "CASE " + " ".join(f"WHEN {c.replace('not is_radio', 'true')} THEN '{n}'" for n, _, c, _ in regions.CLASSES) + " END"


@query(f"WITH b AS (SELECT w, h, w::DOUBLE / h AS ar, w * h AS area, disc * 500 AS energy, disc * 10 AS dispersion, line = 7 AS circular, line = 6 AS arrow, line = 5 AS is_canvas FROM {BOXES_SQL}), c AS (SELECT {CLASS_SQL} AS class FROM b) SELECT class, count(*) AS n FROM c WHERE class IS NOT NULL GROUP BY ALL")
def region_classes(spark, d):
    b = boxes(spark, d).withColumns({"energy": F.col("disc") * 500, "dispersion": F.col("disc") * 10, "circular": F.col("line") == 7, "arrow": F.col("line") == 6, "is_canvas": F.col("line") == 5})
    return regions.classify_regions(b).groupBy("class").agg(F.count("*").alias("n"))


@query(f"""WITH b AS MATERIALIZED (FROM {BOXES_SQL}), c AS (SELECT t.scan_id, t.ord, greatest(t.x, p.x) AS x0, least(t.x + t.w, p.x + p.w) AS x1, greatest(t.y, p.y) AS y0, least(t.y + t.h, p.y + p.h) AS y1 FROM b t JOIN b p ON t.scan_id = p.scan_id AND t.line = 1 AND p.line > 1),
l AS (SELECT scan_id, ord, x0, x1, unnest(range(y0, y1)) AS y FROM c WHERE x1 > x0 AND y1 > y0),
m AS (SELECT *, max(x1) OVER (PARTITION BY scan_id, ord, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l),
a AS (SELECT scan_id, ord, sum(greatest(x1 - greatest(x0, coalesce(reach, x0)), 0)) AS n FROM m GROUP BY ALL)
SELECT b.scan_id, ord AS truth_id, coalesce(n / (w * h), 0)::DOUBLE AS covered FROM b LEFT JOIN a USING (scan_id, ord) WHERE line = 1""")
def union_coverage(spark, d):
    t, p = truth_and_predictions(spark, d)
    return regions.union_coverage(t.withColumn("truth_id", F.col("ord")), p)


@query()
def screen_classes(spark, d):
    e = io.page_elements(table(spark, d, "pages")).filter("role <> 'text'")
    marks = e.select(F.col("page_id").alias("scan_id"), "role", "tag", F.col("text").alias("label"))
    scans = table(spark, d, "pages").select(F.col("page_id").alias("scan_id"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1).alias("path"), F.lit(800).alias("viewport_height"))
    return regions.classify_screens(marks, scans)


@query()
def element_ids(spark, d):
    e = io.page_elements(table(spark, d, "pages")).withColumn("label", F.left("text", F.lit(40))).withColumns({"path": F.col("ord").cast("string"), **{c: F.lit(0) for c in "xywh"}})
    return regions.stable_ids(e).select("page_id", "ord", "stable_id")


HASH_SQL = "abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(seed, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c + 2147483648) % 4294967296 - 2147483648 + CASE WHEN (h * 31 + c + 2147483648) % 4294967296 < 0 THEN 4294967296 ELSE 0 END))"


@query(f"""WITH RECURSIVE b AS (SELECT scan_id, ord, coalesce(source, '') || '|' || concat_ws('|', (floor(x / 4 + 0.5))::BIGINT, (floor(y / 4 + 0.5))::BIGINT, 5, 5) AS seed FROM (SELECT scan_id, ord, source, x // 100 * 100 AS x, y // 200 * 4 AS y FROM {BOXES_SQL})),
h AS (SELECT scan_id, ord, {HASH_SQL} % 8999999 AS own FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY own, ord) AS i FROM h),
t AS (SELECT scan_id, ord, i, own AS slot FROM o WHERE i = 1 UNION ALL SELECT o.scan_id, o.ord, o.i, greatest(o.own, t.slot + 1) FROM t JOIN o ON o.scan_id = t.scan_id AND o.i = t.i + 1)
SELECT scan_id, ord, slot + 1000 AS stable_id FROM t""")
def box_ids(spark, d):
    """Boxes told apart coarsely, so that most ids are probed for; the SQL puts in one box after the other."""
    b = boxes(spark, d).select("scan_id", "ord", F.col("source").alias("label"), (F.floor(F.col("x") / 100) * 100).alias("x"), (F.floor(F.col("y") / 200) * 4).alias("y"), F.lit(20).alias("w"), F.lit(20).alias("h"))
    return regions.stable_ids(b, "scan_id").select("scan_id", "ord", "stable_id")


@query("SELECT page_id, len(regexp_extract_all(html, '<li>')) AS links FROM pages WHERE regexp_matches(html, '<li>')")
def page_links(spark, d):
    return io.page_elements(table(spark, d, "pages")).filter("role = 'link'").groupBy("page_id").agg(F.count("*").alias("links"))


def walled(spark: SparkSession, d: str) -> DataFrame:
    """pages, of which some are made to ask for proof of a human: by their address, a widget, or a text."""
    k = F.col("page_id") % 11
    html = F.coalesce("html", F.lit(""))
    text = F.when(k == 2, F.concat(F.lit("<iframe src='https://w.example/recaptcha/api'></iframe>"), html)).when(k == 3, F.concat(F.lit("<p>Please verify you are human</p><script>1</script>"), html)).when(k == 4, F.concat(F.lit("<script>please verify you are human</script>"), html)).otherwise(html)
    return table(spark, d, "pages").select("page_id", F.when(k == 1, F.concat("url", F.lit("/captcha"))).otherwise(F.col("url")).alias("url"), text.alias("html"))


@query(rf"""WITH p AS (SELECT page_id, CASE WHEN page_id % 11 = 1 THEN url || '/captcha' ELSE url END AS url, CASE page_id % 11 WHEN 2 THEN '<iframe src=''https://w.example/recaptcha/api''></iframe>' WHEN 3 THEN '<p>Please verify you are human</p><script>1</script>' WHEN 4 THEN '<script>please verify you are human</script>' ELSE '' END || coalesce(html, '') AS html FROM pages),
t AS (SELECT *, left(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), 3000) AS text FROM p)
SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS n, count(*) FILTER (WHERE regexp_matches(url_decode(url), {sql_text(runs.WALL_URL)}, 'i')) AS by_address, count(*) FILTER (WHERE regexp_matches(url_decode(url), {sql_text(runs.WALL_URL)}, 'i') OR regexp_matches(html, {sql_text(runs.WALL_WIDGET)}, 'i') OR regexp_matches(text, {sql_text(runs.WALL_TEXT)}, 'i')) AS walls FROM t GROUP BY ALL""")
def walls_by_host(spark, d):
    return runs.bot_walls(walled(spark, d)).groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("wall") == "address").alias("by_address"), F.count_if(F.col("wall").isNotNull()).alias("walls"))


# --- pixels: every embedding as an image of 8 by 8 grey values ---

PIXELS_SQL = "(SELECT vec_id AS image_id, i % 8 AS x, i // 8 AS y, least(greatest(floor(embedding[i + 1]::DOUBLE * 200 + 128), 0), 255)::INT AS r, least(greatest(floor(embedding[i + 1]::DOUBLE * 200 + 128), 0), 255)::INT AS g, least(greatest(floor(embedding[i + 1]::DOUBLE * 200 + 128), 0), 255)::INT AS b FROM embeddings, range(64) t(i))"
LUMA_SQL = "(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)"


def pixels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v"))
    level = F.least(F.greatest(F.floor(F.col("v").cast("double") * 200 + 128), F.lit(0)), F.lit(255)).cast("int")
    return e.select("image_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), level.alias("r"), level.alias("g"), level.alias("b"))


@query(f"WITH p AS (SELECT *, x // 4 AS px, y // 4 AS py FROM {PIXELS_SQL}), m AS (SELECT image_id, px, py, avg(r) AS mr FROM p GROUP BY ALL) SELECT image_id, px, py, round(any_value(mr), 6) AS mean, round(avg(3 * abs(r - mr)), 6) AS energy FROM p JOIN m USING (image_id, px, py) GROUP BY ALL")
def patch_statistics(spark, d):
    return images.patch_stats(pixels(spark, d), 4).select("image_id", "px", "py", F.round("mean_r", 6).alias("mean"), F.round("energy", 6).alias("energy"))


@query(f"WITH c AS (SELECT image_id, round({LUMA_SQL})::INT AS l, count(*) AS n FROM {PIXELS_SQL} GROUP BY ALL) SELECT image_id, round(-sum(n / 64 * log2(n / 64)), 6) AS entropy FROM c GROUP BY ALL")
def image_entropy(spark, d):
    return images.entropy(pixels(spark, d)).select("image_id", F.round("entropy", 6).alias("entropy"))


@query(f"WITH p AS (SELECT image_id, x, y, {LUMA_SQL} AS v FROM {PIXELS_SQL}), n AS (SELECT *, lag(v) OVER a AS l, lead(v) OVER a AS r, lag(v) OVER b AS u, lead(v) OVER b AS d FROM p WINDOW a AS (PARTITION BY image_id, y ORDER BY x), b AS (PARTITION BY image_id, x ORDER BY y)) SELECT image_id, round(avg(abs(4 * v - l - r - u - d)), 6) AS edges FROM n GROUP BY ALL")
def image_edges(spark, d):
    return images.edge_residual(pixels(spark, d)).select("image_id", F.round("edges", 6).alias("edges"))


ENTROPY_SQL = ORACLES["image_entropy"].replace("round(-sum(n / 64 * log2(n / 64)), 6)", "-sum(n / 64 * log2(n / 64))")
EDGES_SQL = ORACLES["image_edges"].replace("round(avg(abs(4 * v - l - r - u - d)), 6)", "avg(abs(4 * v - l - r - u - d))")


@query(f"""WITH e AS (SELECT image_id, entropy, edges FROM ({ENTROPY_SQL}) JOIN ({EDGES_SQL}) USING (image_id)), r AS (SELECT *, greatest(round(100 - (17.5::DOUBLE * entropy + 0.4::DOUBLE * edges), 1), 0) AS resistance, entropy < 0.0001 AND edges < 0.0001 AS zero_information FROM e)
SELECT image_id, round(entropy, 6) AS entropy, round(edges, 6) AS edges, resistance, zero_information, CASE WHEN zero_information THEN 'irrecoverable' WHEN resistance >= 60 THEN 'strong' ELSE 'weak' END AS verdict FROM r""")
def image_resistance(spark, d):
    return images.irrecoverability(pixels(spark, d)).withColumns({c: F.round(c, 6) for c in ("entropy", "edges")})


def image_boxes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"))
    return e.select("image_id", F.posexplode(F.array(F.lit(0), F.lit(3))).alias("box_id", "x")).withColumns({"y": F.lit(1), "w": F.lit(4), "h": F.lit(5)})


@query(f"WITH p AS (SELECT image_id, x, y, {LUMA_SQL} AS v FROM {PIXELS_SQL}), b AS (SELECT vec_id AS image_id, k AS box_id, k * 3 AS bx FROM embeddings, range(2) t(k)) SELECT image_id, box_id::INT AS box_id, count(*) AS n, round(avg((v <= 12)::INT), 6) AS dark_share, round(avg(v), 6) AS mean, round(var_pop(v), 4) AS variance FROM p JOIN b USING (image_id) WHERE x >= bx AND x < bx + 4 AND y BETWEEN 1 AND 5 AND (x - bx) % 2 = 0 AND (y - 1) % 2 = 0 GROUP BY ALL")
def box_statistics(spark, d):
    s = images.region_stats(pixels(spark, d), image_boxes(spark, d))
    return s.select("image_id", "box_id", "n", F.round("dark_share", 6).alias("dark_share"), F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@query(f"""WITH p AS (SELECT *, {LUMA_SQL} AS v FROM {PIXELS_SQL}), b AS (SELECT vec_id AS image_id, k AS box_id, k * 3 AS bx FROM embeddings, range(2) t(k)),
i AS (SELECT image_id, box_id, x, r, v, row_number() OVER (PARTITION BY image_id, box_id ORDER BY v, x, y) - 1 AS place, count(*) OVER (PARTITION BY image_id, box_id) AS n FROM p JOIN b USING (image_id) WHERE x >= bx AND x < bx + 4 AND y BETWEEN 1 AND 5),
g AS (SELECT image_id, box_id, v AS back FROM i WHERE place = n // 2), k AS (SELECT image_id, box_id, count(*) AS n_ink, count(*) FILTER (WHERE x >= 4 OR r <= 8) AS n_same FROM i JOIN g USING (image_id, box_id) WHERE abs(v - back) > 35 GROUP BY ALL)
SELECT image_id, box_id::INT AS box_id, coalesce(n_ink, 0) AS n_ink, coalesce(n_same, 0) AS n_same, coalesce(n_ink >= 20 AND n_same > 0.02 * n_ink, false) AS leaked FROM b LEFT JOIN k USING (image_id, box_id)""")
def surviving_ink(spark, d):
    p = pixels(spark, d)
    dark = p.withColumns({c: F.when(F.col("x") < 4, 0).otherwise(F.col(c)) for c in "rgb"})
    return images.ink_survival(p, dark, image_boxes(spark, d))


@query(f"""WITH RECURSIVE p AS MATERIALIZED (SELECT image_id, x, y, y * 8 + x AS own FROM {PIXELS_SQL} WHERE {LUMA_SQL} - 100 > 18 AND {LUMA_SQL} < 235),
r AS (SELECT image_id, x, y, own AS label FROM p UNION SELECT p.image_id, p.x, p.y, r.label FROM r JOIN p ON p.image_id = r.image_id AND abs(p.x - r.x) <= 1 AND abs(p.y - r.y) <= 1 AND r.label < p.own),
m AS (SELECT image_id, x, y, min(label) AS label FROM r GROUP BY ALL), c AS (SELECT image_id, label, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM m GROUP BY ALL),
k AS (SELECT *, (x1 - x0 + 1) * 16 AS w, (y1 - y0 + 1) * 16 AS h FROM c WHERE n BETWEEN 4 AND 150)
SELECT image_id, label // 8 AS first_y, label % 8 AS first_x, n, x0, y0, x1, y1, CASE WHEN w / h BETWEEN 0.75 AND 1.35 AND w BETWEEN 32 AND 220 THEN 'avatar' WHEN w / h > 2.5 AND h <= 60 THEN 'strip' ELSE 'media' END AS kind FROM k""")
def patch_clusters(spark, d):
    stats = images.patch_stats(pixels(spark, d), 1).select("image_id", "px", "py", (F.col("luminance") - 100).alias("energy"), "luminance")
    return regions.cluster_patches(stats)


# --- quality ---


def matches_sql(lines: int) -> str:
    """CTEs o (boxes), b and s (a walk over the pairs of truth with predictions of lines above that) and m: the matches."""
    pairs = """(SELECT *, shared / aa AS covered, shared / (aa + ba - shared) AS iou FROM (SELECT a.scan_id, a.ord AS a_id, b.ord AS b_id, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0)::BIGINT * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS shared, a.w * a.h AS aa, b.w * b.h AS ba
FROM o a JOIN o b ON a.scan_id = b.scan_id AND a.line = 1 AND b.line > """ + f"{lines}))"
    walk = greedy_sql(pairs, "scan_id", "covered DESC, iou DESC, a_id, b_id", {"a_id": "INT", "b_id": "INT"}, "k.a_id = a_id OR k.b_id = b_id", "WHERE covered >= 0.5")
    return f"WITH RECURSIVE o AS MATERIALIZED (FROM {BOXES_SQL}), {walk}, m AS MATERIALIZED (SELECT scan_id, a_id, b_id, covered, iou FROM b JOIN s USING (scan_id, i) WHERE taken)"


@query(f"{matches_sql(1)} SELECT scan_id, a_id, b_id, round(covered, 9) AS covered, round(iou, 9) AS iou FROM m")
def matched_detections(spark, d):
    return quality.match_detections(*truth_and_predictions(spark, d), cell=BOX_CELL).withColumns({c: F.round(c, 9) for c in ("covered", "iou")})


@query(f"""{matches_sql(2)}, n AS (SELECT scan_id, count(*) FILTER (WHERE line = 1) AS n_truth, count(*) FILTER (WHERE line > 2) AS n_pred FROM o GROUP BY ALL HAVING count(*) FILTER (WHERE line <> 2) > 0),
t AS (SELECT scan_id, count(*) AS tp, round(avg(iou), 9) AS mean_iou FROM m GROUP BY ALL),
f AS (SELECT scan_id, ord, x, y, w, h FROM o WHERE line > 2 AND NOT EXISTS (SELECT 1 FROM m WHERE m.scan_id = o.scan_id AND b_id = ord)),
g AS (SELECT f.scan_id, count(DISTINCT f.ord) AS harmful FROM o a JOIN f ON a.scan_id = f.scan_id AND a.line = 2 WHERE greatest(least(a.x + a.w, f.x + f.w) - greatest(a.x, f.x), 0)::BIGINT * greatest(least(a.y + a.h, f.y + f.h) - greatest(a.y, f.y), 0) >= 0.5 * (a.w * a.h) GROUP BY ALL)
SELECT scan_id, n_truth, n_pred, coalesce(tp, 0) AS tp, mean_iou, coalesce(harmful, 0) AS harmful, coalesce(tp, 0) / nullif(n_truth, 0) AS recall, coalesce(tp, 0) / nullif(coalesce(tp, 0) + coalesce(harmful, 0), 0) AS precision FROM n LEFT JOIN t USING (scan_id) LEFT JOIN g USING (scan_id)""")
def detection_rates(spark, d):
    b = stored(boxes(spark, d).select("scan_id", "ord", "x", "y", "w", "h", "line"), "boxes")  # read six times
    return quality.detection_quality(b.filter("line = 1"), b.filter("line > 2"), b.filter("line = 2"), cell=BOX_CELL).withColumn("mean_iou", F.round("mean_iou", 9))


@query(f"{PAIRS_SQL}, s AS (SELECT scan_id, a_id, list_sort(list_distinct(list(source))) AS s FROM j WHERE shared / aa >= 0.5 GROUP BY ALL), t AS (SELECT coalesce(s, []) AS s FROM b LEFT JOIN s ON s.scan_id = b.scan_id AND s.a_id = b.ord WHERE line = 1) SELECT count(*) FILTER (WHERE list_contains(s, 'dom')) AS dom, count(*) FILTER (WHERE list_contains(s, 'vision_ocr')) AS ocr, count(*) FILTER (WHERE list_contains(s, 'vision_face')) AS face, count(*) FILTER (WHERE s = ['vision_ocr']) AS only_ocr, count(*) FILTER (WHERE s = ['vision_face']) AS only_face, count(*) FILTER (WHERE len(s) = 0) AS uncovered FROM t")
def reached_by_source(spark, d):
    return quality.source_counts(quality.covered_by(*truth_and_predictions(spark, d), cell=BOX_CELL))


@query(f"WITH b AS (FROM {BOXES_SQL}), a AS (SELECT scan_id, coalesce(sum(w * h) FILTER (WHERE line = 1), 0)::BIGINT AS truth_area, coalesce(sum(w * h) FILTER (WHERE line > 1), 0)::BIGINT AS masked_area FROM b GROUP BY ALL) SELECT *, masked_area / 60000 AS share, masked_area / nullif(truth_area, 0) AS inflation FROM a")
def masked_areas(spark, d):
    return quality.mask_area(*truth_and_predictions(spark, d), 60000)


def timings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("fixture"), (F.col("event_id") % 3 == 0).alias("cached"), F.col("value").alias("scan"), (F.col("value") * 2).alias("merge"), F.when(F.col("event_id") % 2 == 0, F.col("value") + 1).alias("redact"))


@query("WITH t AS (SELECT event_type AS fixture, event_id % 3 = 0 AS cached, unnest(['scan', 'merge', 'redact']) AS stage, unnest([value, value * 2, CASE WHEN event_id % 2 = 0 THEN value + 1 END]) AS ms FROM events), u AS (SELECT * FROM t WHERE ms IS NOT NULL) SELECT fixture, cached, stage, count(*) AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95 FROM u GROUP BY GROUPING SETS ((fixture, cached, stage), (cached, stage))")
def latencies(spark, d):
    return quality.latency_profile(timings(spark, d), ["scan", "merge", "redact"])


def event_runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as task runs."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("run_id"), F.col("o_orderpriority").alias("page"), F.when(k % 2 == 0, "ocr").otherwise("fast").alias("profile"), (F.col("o_orderstatus") == "F").alias("done"), F.when(k % 7 == 0, "timeout").alias("error"), (k % 3 != 0).alias("outcome_verified"), (k % 5 != 0).alias("clean_termination"), (k % 4).alias("incorrect_actions"), (10 + k % 9).alias("steps"), (k % 3).alias("loop_incidents"), (k % 2).alias("loop_recoveries"), F.col("o_totalprice").alias("run_ms"), F.col("o_totalprice").alias("total_ms"), (k % 10 / 10).alias("recall"), (k % 2).alias("leaks"))


@query("WITH r AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS done, o_orderkey % 7 = 0 AS err, o_orderkey % 3 != 0 AS ok, o_totalprice AS ms FROM orders) SELECT count(*) AS n, avg(done::INT) AS completion, avg((k % 5 != 0)::INT) AS clean, avg((done AND NOT err AND NOT ok)::INT) AS fp_rate, avg(((NOT done OR err) AND NOT ok)::INT) AS fn_rate, sum(k % 4) / sum(10 + k % 9) AS incorrect_rate, sum(k % 3) / count(*) AS loops_a_run, sum(k % 2) / sum(k % 3) AS recovery, round(avg(ms), 4) AS mean_run_ms FROM r")
def run_reliability(spark, d):
    return quality.reliability(event_runs(spark, d)).withColumn("mean_run_ms", F.round("mean_run_ms", 4))


@query("PIVOT (SELECT o_orderpriority AS page, CASE WHEN o_orderkey % 2 = 0 THEN 'ocr' ELSE 'fast' END AS profile, o_orderkey % 10 / 10 AS r, o_orderkey % 2 AS l, o_totalprice AS t FROM orders) ON profile IN ('ocr', 'fast') USING round(avg(r), 9) AS recall, sum(l)::BIGINT AS leaks, round(avg(t), 4) AS ms GROUP BY page")
def profiles_compared(spark, d):
    df = quality.profile_compare(event_runs(spark, d), ["ocr", "fast"])
    return df.select("page", *(F.round(c, 9).alias(c) if c.endswith("recall") else F.round(c, 4).alias(c) if c.endswith("ms") else F.col(c) for c in df.columns if c != "page"))


@query("WITH s AS (SELECT l_orderkey AS run, l_linenumber AS ord, bool_and(l_discount < 0.08) AS ok FROM lineitem GROUP BY ALL), g AS (SELECT run, count(*) AS n, min(ord) FILTER (WHERE NOT ok) AS miss, min(ord) AS first FROM s GROUP BY ALL) SELECT run, n, coalesce(miss - first, n)::BIGINT AS depth, coalesce(miss - first, n) >= ceil(0.6 * n) AS reached FROM g")
def stage_depths(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("ord")).agg(F.bool_and(F.col("l_discount") < 0.08).alias("ok"))
    return quality.stage_depth(s)


@query("WITH m AS (SELECT DISTINCT l_suppkey AS page, l_linenumber AS rep, l_returnflag AS id FROM lineitem), s AS (SELECT page, rep, list_sort(list(id)) AS ids FROM m GROUP BY ALL) SELECT page, count(*) AS repeats, count(DISTINCT ids) AS n_sets, count(*) >= 2 AND count(DISTINCT ids) = 1 AS stable FROM s GROUP BY ALL")
def stable_pages(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_linenumber").alias("repeat"), F.col("l_returnflag").alias("mark_id"))
    return quality.id_stability(li)


@query("WITH r AS (SELECT o_orderpriority AS page, o_orderkey % 10 / 10 AS recall, o_orderkey % 2 AS leaks, o_totalprice AS t FROM orders), p AS (SELECT page, avg(recall) AS recall, sum(leaks) AS leaks FROM r GROUP BY ALL) SELECT count(*) AS pages, round(avg(recall), 9) AS recall, sum(leaks)::BIGINT AS leaks, bool_and(leaks = 0) AS clean FROM p")
def overall_quality(spark, d):
    r = event_runs(spark, d).withColumns({"precision": F.col("recall"), "mean_iou": F.col("recall"), "missed": F.array().cast("array<string>")})
    return quality.overall_metrics(quality.page_metrics(r)).select("pages", F.round("recall", 9).alias("recall"), "leaks", "clean")


# --- logs: events as the steps of one run a user ---

STEPS_SQL = "(SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, ts, event_type AS action, NULL AS target, (floor(value / 20))::INT::VARCHAR AS value, '' AS label, event_type != 'error' AS ok FROM events)"


def steps(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("run_id"), F.row_number().over(order).alias("step"), "ts", F.col("event_type").alias("action"), F.lit(None).cast("string").alias("target"), F.floor(F.col("value") / 20).cast("int").cast("string").alias("value"), F.lit("").alias("label"), (F.col("event_type") != "error").alias("ok"))


@query(f"WITH s AS (FROM {STEPS_SQL}), t AS (SELECT run_id, step, coalesce(sum(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.5 END) OVER (PARTITION BY run_id, action, value ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS score FROM s) SELECT run_id, step, score, score >= 2 AS alert FROM t")
def loops(spark, d):
    return runs.detect_loops(steps(spark, d))


@query(f"WITH s AS (FROM {STEPS_SQL}), t AS (SELECT *, action = lag(action) OVER w AND value = lag(value) OVER w AS same FROM s WINDOW w AS (PARTITION BY run_id ORDER BY step)) SELECT run_id, count(*) FILTER (WHERE same) AS duplicates, count(*) FILTER (WHERE NOT ok) AS failed FROM t GROUP BY ALL")
def duplicate_steps(spark, d):
    return runs.consecutive_duplicates(steps(spark, d))


@query(f"WITH s AS (FROM {STEPS_SQL}), t AS (SELECT *, sum(ok::INT) OVER (PARTITION BY run_id ORDER BY step) AS i FROM s), u AS (SELECT run_id, i, min(step) AS first_step, max(step) AS last_step, count(*) AS failures FROM t WHERE NOT ok GROUP BY ALL) SELECT run_id, first_step, last_step, failures, failures >= 3 AS stop FROM u")
def streaks_of_failure(spark, d):
    return runs.failure_streaks(steps(spark, d), 3)


@query(f"WITH s AS (FROM {STEPS_SQL}), t AS (SELECT *, coalesce(action != lag(action) OVER w, true) AS fresh FROM s WINDOW w AS (PARTITION BY run_id ORDER BY step)), u AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY run_id ORDER BY step) AS i FROM t), g AS (SELECT run_id, i, min(step) AS first_step, count(*) - 1 AS repeats FROM u GROUP BY ALL) SELECT run_id, first_step, repeats FROM g WHERE repeats >= 2")
def stalls(spark, d):
    s = steps(spark, d).withColumns({"url": F.col("action"), "scroll_y": F.lit(0), "marks": F.lit(0), "completed": F.lit(0)})
    return runs.detect_stalls(s, 2)


@query(f"WITH s AS (FROM {STEPS_SQL}), t AS (SELECT *, epoch(date_trunc('second', ts))::BIGINT - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY run_id ORDER BY ts, step)))::BIGINT AS g FROM s), u AS (SELECT run_id, epoch(date_trunc('second', max(ts)))::BIGINT - epoch(date_trunc('second', min(ts)))::BIGINT AS seconds, coalesce(max(g), 0) AS longest, count(*) AS steps FROM t GROUP BY ALL) SELECT * FROM u WHERE seconds > 600 OR longest > 60 OR steps > 60")
def budgets_broken(spark, d):
    return runs.budget_breaches(steps(spark, d))


@query("WITH t AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 1 HOUR, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), u AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM t) SELECT user_id, min(ts) AS first_at, max(ts) + INTERVAL 1 HOUR AS fires_at, count(*) AS n FROM u GROUP BY user_id, i")
def bursts(spark, d):
    return runs.debounce(table(spark, d, "events").select("user_id", "ts"), "user_id", "1 hour")


MESSAGES_SQL = "(SELECT event_id, event_type AS provider, ts, CASE event_id % 5 WHEN 0 THEN '429 rate limit, try again in 1m2.5s' WHEN 1 THEN 'HTTP 401' WHEN 2 THEN 'Quota exceeded' WHEN 3 THEN 'Permission denied' ELSE 'connection reset' END AS message FROM events)"


def provider_errors(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 5
    message = F.when(m == 0, "429 rate limit, try again in 1m2.5s").when(m == 1, "HTTP 401").when(m == 2, "Quota exceeded").when(m == 3, "Permission denied").otherwise("connection reset")
    return table(spark, d, "events").select("event_id", "event_type", "user_id", F.col("event_type").alias("provider"), "ts", message.alias("message"))


OUTAGES_SQL = f"(SELECT event_id, provider, ts, ts + to_microseconds((CASE event_id % 5 WHEN 0 THEN 67.5 WHEN 2 THEN 90 WHEN 4 THEN 30 ELSE 1800 END * 1000000)::BIGINT) AS until, CASE event_id % 5 WHEN 0 THEN 'rate limited' WHEN 2 THEN 'rate limited' WHEN 4 THEN 'erroring' ELSE 'rejected our credentials' END AS kind FROM {MESSAGES_SQL})"


@query(f"SELECT provider, ts, until, kind FROM {OUTAGES_SQL}")
def outages(spark, d):
    return runs.outage_intervals(provider_errors(spark, d))


@query(f"WITH o AS (SELECT o.until, o.ts, 'p' || user_id AS provider FROM {OUTAGES_SQL} o JOIN events USING (event_id) WHERE event_type = 'error'), c AS (SELECT event_id, 'p' || user_id AS provider, ts FROM events WHERE event_type <> 'error') SELECT c.event_id AS call_id, c.provider, c.ts, coalesce(c.ts < o.until, false) AS unavailable FROM c ASOF LEFT JOIN o ON c.provider = o.provider AND c.ts >= o.ts")
def calls_in_outages(spark, d):
    """Every event is an error or a call, by its type; a user's events are those of one provider."""
    e = provider_errors(spark, d).withColumn("provider", F.concat(F.lit("p"), "user_id"))
    calls = e.filter("event_type <> 'error'").select(F.col("event_id").alias("call_id"), "provider", "ts")
    return runs.unavailable_calls(calls, runs.outage_intervals(e.filter("event_type = 'error'")))


def audit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("entry_id"), F.col("ts").alias("at"), "user_id", F.concat(F.lit("/u/"), (F.col("user_id") % 7).cast("string")).alias("url"), F.length("props").cast("long").alias("bytes"), F.when(F.col("event_type") == "error", "failed").alias("error"), F.col("props").alias("body"), F.col("event_type").alias("task"), F.when(F.col("event_id") % 2 == 0, "img").alias("image"))


@query("SELECT user_id, count(*) AS n, sum(length(props))::BIGINT AS bytes, max(ts) AS last_at, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT event_id % 5) AS destinations FROM events GROUP BY ALL")
def audit_by_user(spark, d):
    return runs.audit_summary(audit(spark, d).withColumn("url", F.concat(F.lit("/u/"), F.col("entry_id") % 5)), ["user_id"])


@query("WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_id AS entry_id, n > 6 AND event_id % 2 = 0 AS image_dropped FROM t WHERE n <= 120")
def audit_kept(spark, d):
    return runs.audit_retention(audit(spark, d), "user_id").select("user_id", "entry_id", "image_dropped")


@query("SELECT user_id AS u, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 50 GROUP BY ALL")
def latest_runs(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_id", "run_id")
    return runs.recent_runs(e, "user_id").groupBy(F.col("user_id").alias("u")).agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN regexp_matches(p_name, {sql_text(runs.RISKY)}, 'i') THEN 'risky label' WHEN trim(p_name) = '' THEN 'no label' END AS gate_reason, count(*) AS n FROM part GROUP BY ALL")
def click_gates(spark, d):
    return runs.click_risk(table(spark, d, "part").select(F.col("p_name").alias("label"), F.lit("button").alias("role"))).groupBy("gate_reason").agg(F.count("*").alias("n"))


# --- facets, ranking, mapping ---


@query("SELECT p_partkey, n AS query, NULL::DOUBLE AS min_price, p_size * 1000.0::DOUBLE AS max_price, CASE WHEN p_partkey % 2 = 0 THEN 'cheapest' END AS pick FROM (SELECT *, p_name AS n FROM part)")
def part_requests(spark, d):
    return requests(spark, d).select("p_partkey", "query", "min_price", "max_price", "pick")


def requests(spark: SparkSession, d: str) -> DataFrame:
    """A request for every part: 'search for NAME and show me results, under SIZEk', half of them the cheapest."""
    text = F.concat(F.lit("under "), F.col("p_size"), F.lit("k "), F.when(F.col("p_partkey") % 2 == 0, "cheapest ").otherwise(""), F.lit("search for "), F.col("p_name"), F.lit(" and show me the results please"))
    return facets.request_facets(table(spark, d, "part").withColumn("text", text))


@query("SELECT pick, sort_key, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'cheapest' END AS pick, CASE WHEN p_partkey % 2 = 0 THEN 'price_asc' END AS sort_key FROM part) GROUP BY CUBE (pick, sort_key)")
def facet_cube(spark, d):
    return facets.facet_counts(requests(spark, d), ["pick", "sort_key"])


REQUESTS = ["I need a new part today: run the NAME search; sort the results by price, then check it.", "open NAME and press the NAME button and then fill the form, please; close it", "search for NAME and open the detail page of NAME and show me the prices!", "note: NAME", "  ", "hit NAME next narrow the list to NAME. add it; save and submit, review, find NAME, set it, book it"]
STEP_VERBS_SQL = "search|find|look|filter|narrow|sort|rank|open|click|select|choose|pick|show|compare|add|put|fill|enter|type|scroll|save|submit|apply|set|book|review|check"
REPHRASED_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, {sql_text(p)}) THEN trim(regexp_replace(t, {sql_text(p)}, {sql_text(w.replace('$', chr(92)))}))" for p, w in facets.REPHRASED) + " ELSE t END"


def worded_requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumn("text", F.replace(F.element_at(F.array(*map(F.lit, REQUESTS)), (F.col("p_partkey") % len(REQUESTS) + 1).cast("int")), F.lit("NAME"), F.col("p_name")))


@query(rf"""WITH q AS (SELECT p_partkey, trim(replace({REQUESTS}[p_partkey % {len(REQUESTS)} + 1], 'NAME', p_name)) AS t FROM part),
c AS (SELECT p_partkey, t, list_filter(list_transform(string_split(regexp_replace(t, '(?:\s*[,;.]\s*|\s+(?:and(?:\s+then)?|then|after that|finally|next)\s+)((?:{STEP_VERBS_SQL})\b)', chr(1) || '\1', 'gi'), chr(1)), lambda x: trim(x, ' ,;.')), lambda x: x <> '') AS p FROM q),
s AS (SELECT p_partkey, unnest(range(least(greatest(len(p), 1), 7)))::INT AS step, unnest(CASE WHEN len(p) > 0 THEN p[1:7] ELSE [t] END) AS t FROM c),
l AS (SELECT p_partkey, step, CASE WHEN step = 0 AND contains(t, ':') AND len(string_split(split_part(t, ':', 1), ' ')) > 3 THEN trim(substr(t, strpos(t, ':') + 1)) ELSE t END AS t FROM s)
SELECT p_partkey, step, left({REPHRASED_SQL}, 160) AS task FROM l""")
def request_steps(spark, d):
    return facets.split_steps(worded_requests(spark, d), "p_partkey")


@query(r"""WITH q AS (SELECT p_partkey, p_name AS n, p_partkey % 3 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN [lower(n), 'first ' || lower(n)] WHEN 1 THEN ['cart ' || lower(n)] ELSE []::VARCHAR[] END AS targets FROM q""")
def open_targets(spark, d):
    """Three kinds of requests: two things to open, one to click, none."""
    k, n = F.col("p_partkey") % 3, F.col("p_name")
    text = F.when(k == 0, F.concat(F.lit("search for it and open the "), n, F.lit(" then also select first "), n, F.lit(" and show me the prices"))).when(k == 1, F.concat(F.lit("Buy it and click on the CART "), n)).otherwise(F.concat(F.lit("open "), n))
    return table(spark, d, "part").select("p_partkey", facets.open_targets(text).alias("targets"))


@query("WITH b AS (SELECT DISTINCT p_brand FROM part), w AS (SELECT p_partkey, p_retailprice, p_size % 6 AS r, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS z FROM part), q AS (SELECT s_suppkey AS task_id, n.a || ' ' || n.z AS query, n.a, n.z FROM supplier JOIN w n ON n.p_partkey = s_suppkey), s AS (SELECT task_id, p_partkey, 100 + 50 * ((w.a = q.a)::INT + (w.z = q.z)::INT) + CASE WHEN p_retailprice > 1000 THEN -500 ELSE 150 END + CASE WHEN r < 3 THEN -500.0 ELSE 40.0 * r END - CASE WHEN p_partkey % 10 = 0 THEN 30 ELSE 0 END AS score FROM q JOIN w ON w.a = q.a OR w.z = q.z), o AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, p_partkey) AS n FROM s) SELECT task_id, p_partkey AS listing_id, score::DOUBLE AS score FROM o WHERE n = 1 AND score > 0")
def products_chosen(spark, d):
    p = table(spark, d, "part")
    listings = p.select(F.col("p_partkey").alias("listing_id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"), (F.col("p_size") % 6).cast("double").alias("rating"), (F.col("p_partkey") % 10 == 0).alias("sponsored"))
    tasks = table(spark, d, "supplier").join(p, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("task_id"), F.col("p_name").alias("query"), F.lit(1000.0).alias("max_price"), F.lit(3.0).alias("min_rating"), F.lit(None).cast("string").alias("pick"))
    return facets.select_products(tasks, listings)


@query("SELECT c_custkey AS owner, k AS key, CASE WHEN k = 'name' THEN c_name WHEN c_custkey % 3 = 0 THEN n_name ELSE c_mktsegment END AS value, CASE WHEN k = 'name' OR c_custkey % 3 != 0 THEN 'crm' ELSE 'geo' END AS source FROM customer JOIN nation ON n_nationkey = c_nationkey, (SELECT unnest(['name', 'place']) AS k)")
def merged_sources(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 rows at any size
    rows = F.array(*(F.struct(F.lit(s).alias("source"), F.lit(p).alias("priority"), F.lit(k).alias("key"), v.alias("value")) for s, p, k, v in (("crm", 2, "Full Name", F.col("c_name")), ("crm", 2, "Place", F.when(F.col("c_custkey") % 3 == 0, "n/a").otherwise(F.col("c_mktsegment"))), ("geo", 1, "place", F.col("n_name")))))
    return facets.merge_by_priority(c.select(F.col("c_custkey").alias("owner"), F.inline(rows)), spark.createDataFrame([("full_name", "name")], "alias string, name string"))


@query("SELECT event_id, 'k' AS action, how FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'strict' WHEN 1 THEN 'quotes' ELSE 'keys' END AS how FROM events)")
def repaired_replies(spark, d):
    m = F.col("event_id") % 3
    text = F.when(m == 0, F.lit('{"action": "k", "value": "v"}')).when(m == 1, F.lit("sure: {'action': 'k'}")).otherwise(F.lit("{action: 'k', value: 'v'}"))
    return facets.repair_json(table(spark, d, "events").withColumn("text", text)).select("event_id", "reply.action", "how")


@query("SELECT user_id AS scan_id, event_id AS step, CASE WHEN event_id % 4 = 0 THEN 'scroll_page' ELSE 'click' END AS action, CASE WHEN event_id % 4 != 0 AND event_id % 3 != 0 THEN event_id END AS mark_id, CASE WHEN event_id % 4 != 0 AND event_id % 3 = 0 THEN 'no such mark' END AS note FROM events")
def plans_checked(spark, d):
    e = table(spark, d, "events")
    marks = e.filter("event_id % 3 <> 0").select(F.col("user_id").alias("scan_id"), F.col("event_id").alias("mark_id"))
    plans = e.select(F.col("user_id").alias("scan_id"), F.col("event_id").alias("step"), F.when(F.col("event_id") % 4 == 0, "scroll").otherwise("click").alias("action"), F.when(F.col("event_id") % 4 != 0, F.col("event_id")).alias("mark_id"))
    return facets.validate_plans(plans, marks).select("scan_id", "step", "action", "mark_id", "note")


@query("SELECT conv_id, count(*)::INT AS turns, string_agg('## ' || coalesce(role, 'unknown') || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY ALL")
def conversation_texts(spark, d):
    return io.conversation_texts(table(spark, d, "conversations"))


@query("SELECT conv_id, count(*)::INT AS turns, string_agg('## ' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || ' mail [EMAIL_1]', chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY ALL")
def exported_conversations(spark, d):
    return io.export_conversations(planted_turns(spark, d))


from maskline.plans import records, screens  # noqa: E402, F401  they register their queries
