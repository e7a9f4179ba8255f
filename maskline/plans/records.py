"""Queries over logs, state and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.operators import marks, quality, redact, runs
from maskline.plans.registry import query, table
from maskline.sources import io

# --- events as the lines of a session log: some cut short, some without an event, some blank ---


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    entry = F.concat(F.lit('{"timestamp": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z", "event": "'), F.col("event_type"), F.lit('", "data": {"who": "u'), F.col("user_id"), F.lit('", "in": '), F.col("props"), F.lit("}}"))
    k = F.col("event_id") % 9
    return e.select("event_id", F.when(k == 1, F.left(entry, F.length(entry) - 2)).when(k == 2, F.col("props")).when(k == 3, F.lit("  ")).otherwise(entry).alias("value"))


LOG_SQL = """WITH l AS (SELECT *, event_id % 9 AS m FROM events)
SELECT event_id, date_trunc('second', ts) AS at, event_type AS event, 'u' || user_id AS who, (props::JSON->>'k')::BIGINT AS k, NULL::BIGINT AS nothing, NULL::VARCHAR AS malformed FROM l WHERE m NOT IN (1, 2, 3)
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, CASE m WHEN 2 THEN props ELSE '{"timestamp": "' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z", "event": "' || event_type || '", "data": {"who": "u' || user_id || '", "in": ' || props END FROM l WHERE m IN (1, 2)"""


@query(LOG_SQL)
def logged_fields(spark, d):
    log = io.session_log(log_lines(spark, d))
    fields = io.data_fields(log, {"who": ("$.who", "string"), "k": ("$.in.k", "long"), "nothing": ("$.who", "long")})
    return fields.select("event_id", F.col("timestamp").cast("timestamp_ntz").alias("at"), "event", "who", "k", "nothing", "malformed")


# --- forms: events as submissions and deletions ---


def form_changes(spark: SparkSession, d: str) -> DataFrame:
    """A user's errors delete their forms, some the forms of all; other events submit one of five forms, or one that isn't known."""
    e = table(spark, d, "events")
    error, form = F.col("event_type") == "error", F.element_at(F.array(*map(F.lit, (*runs.FORMS, "leave"))), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select(F.when(error, "delete").otherwise("submit").alias("kind"), F.when(~error | (F.col("event_id") % 50 != 0), F.concat(F.lit("e"), "user_id")).alias("emp"), F.when(~error, form).alias("form_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


@query(f"""WITH c AS (SELECT event_type = 'error' AS gone, CASE WHEN event_type <> 'error' OR event_id % 50 <> 0 THEN 'e' || user_id END AS emp, {list(runs.FORMS) + ['leave']}[event_id % 6 + 1] AS form_id, ts, event_id FROM events),
s AS (SELECT emp, form_id, arg_max((ts, event_id), (ts, event_id)) AS t FROM c WHERE NOT gone AND form_id <> 'leave' GROUP BY ALL)
SELECT emp, form_id, t[1] AS submitted_at FROM s WHERE NOT EXISTS (FROM c WHERE gone AND (c.emp IS NULL OR c.emp = s.emp) AND (c.ts, c.event_id) > s.t)""")
def forms_open(spark, d):
    return runs.forms_latest(form_changes(spark, d)).withColumn("submitted_at", F.col("submitted_at").cast("timestamp_ntz"))


@query("SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE conv_id % 3 <> 1")
def messages_seen(spark, d):
    """Turns as encrypted messages: a third of them for one person, a third for another, a third for nobody."""
    key = F.lit("0123456789abcdef0123456789abcdef").cast("binary")
    k = F.col("conv_id") % 3
    m = table(spark, d, "conversations").select("conv_id", "turn", F.when(k == 0, "NK").when(k == 1, "RV").otherwise("").alias("emp_initials"), F.coalesce("text", F.lit("")).alias("ciphertext"))
    return runs.messages_view(redact.encrypt_columns(m, ["ciphertext"], key), "NK", key).select("conv_id", "turn", "text")


# --- a quality report: orders as scans, line items as regions by source ---


def report_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    share = lambda n: (k % n / n).cast("double")
    scans = o.select((F.col("o_custkey") % 40).alias("page"), (F.col("o_custkey") % 40 + 3).alias("regions"), F.when(k % 11 != 0, share(10)).alias("recall"), share(7).alias("precision"), share(9).alias("mean_iou"), (k % 2).alias("leaks"), share(50).alias("ink"), share(20).alias("masked"), share(4).alias("mark_recall"), share(5).alias("role_accuracy"), F.when(k % 13 == 0, share(6)).alias("mark_iou"), F.col("o_totalprice").cast("double").alias("total_ms"), (k > 0).alias("ids_stable"))
    li = table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "dom").when(F.col("l_returnflag") == "N", "vision_ocr").otherwise("vision_face")
    return scans, li.select((F.col("l_suppkey") % 40).alias("page"), kind.alias("source"), F.col("l_linenumber").alias("n"), (F.col("l_linenumber") % 2).alias("only_n"))


SCANS_SQL = "(SELECT o_custkey % 40 AS page, o_custkey % 40 + 3 AS regions, CASE WHEN k % 11 <> 0 THEN k % 10 / 10 END AS recall, k % 7 / 7 AS precision, k % 9 / 9 AS mean_iou, k % 2 AS leaks, k % 50 / 50 AS ink, k % 20 / 20 AS masked, k % 4 / 4 AS mark_recall, k % 5 / 5 AS role_accuracy, CASE WHEN k % 13 = 0 THEN k % 6 / 6 END AS mark_iou, o_totalprice AS total_ms, k > 0 AS stable FROM (SELECT *, o_orderkey AS k FROM orders))"
MEANS = ["recall", "precision", "mean_iou", "ink", "masked", "mark_recall", "role_accuracy", "mark_iou", "total_ms"]
PAGES_SQL = f"(SELECT page, max(regions)::DOUBLE AS regions, sum(leaks)::DOUBLE AS leaks, {', '.join(f'avg({m}) AS {m}' for m in MEANS)}, quantile_disc(total_ms, 0.95) AS p95, bool_and(stable) AS stable FROM {SCANS_SQL} GROUP BY page)"


@query(f"SELECT page, regions, leaks, {', '.join(f'round({m}, 6) AS {m}' for m in MEANS)} FROM {PAGES_SQL}")
def report_pages(spark, d):
    df = quality.report(*report_rows(spark, d))["pages"]
    return df.select("page", "regions", "leaks", *(F.round(m, 6).alias(m) for m in MEANS))


@query(f"""WITH p AS (FROM {PAGES_SQL}), r AS (SELECT {', '.join(f'avg({m}) AS {m}' for m in MEANS)}, sum(regions) AS regions, sum(leaks) AS leaks, quantile_disc(p95, 0.95)::DOUBLE AS p95_ms, bool_and(stable)::INT::DOUBLE AS ids_stable FROM p)
SELECT metric, round(value, 6) AS value FROM (UNPIVOT (SELECT {', '.join(f'{m}::DOUBLE AS {m}' for m in MEANS)}, regions, leaks, p95_ms, ids_stable FROM r) ON COLUMNS(*) INTO NAME metric VALUE value)""")
def report_overall(spark, d):
    return quality.report(*report_rows(spark, d))["overall"].select("metric", F.round("value", 6).alias("value"))


@query("""SELECT l_suppkey % 40 AS page, coalesce(sum(l_linenumber) FILTER (WHERE l_returnflag = 'A'), 0)::BIGINT AS dom, coalesce(sum(l_linenumber) FILTER (WHERE l_returnflag NOT IN ('A', 'N')), 0)::BIGINT AS face, coalesce(sum(l_linenumber) FILTER (WHERE l_returnflag = 'N'), 0)::BIGINT AS ocr,
coalesce(sum(l_linenumber % 2) FILTER (WHERE l_returnflag = 'N'), 0)::BIGINT AS only_ocr, grouping(l_suppkey % 40)::INT AS "all" FROM lineitem GROUP BY GROUPING SETS ((l_suppkey % 40), ())""")
def report_detectors(spark, d):
    return quality.report(*report_rows(spark, d))["detectors"]


# --- marks: parts as the elements of twenty pages, each with one request ---

#: Kind of request, its text; and what marks its pages show: kind, role, label, and the score that the rules have to give.
WISHES = {"msg": "send hello to Asha on whatsapp", "shop": "search for red shoes", "cart": "search for red shoes and add to cart", "flight": "book a flight from New Delhi to Goa on Friday", "other": "open it"}
SHOWN = [
    ("msg", "button", "Send", 800), ("msg", "button", "Send document", -1000), ("msg", "editable", "x", 600), ("msg", "input:text", "Search", 400), ("msg", "button", "Back", 300), ("msg", "link", "Hotels", 0),
    ("shop", "input:search", "", 500), ("shop", "button", "Go", 200), ("shop", "link", "Sign in", -1000), ("shop", "link", "Your cart", -1000), ("shop", "listitem", "shoes", 70), ("shop", "link", "Hotels", 0),
    ("cart", "button", "Add to Cart", 800), ("cart", "link", "Your cart", 0), ("cart", "link", "Best sellers", -1000), ("cart", "input:text", "Keyword", 500),
    ("flight", "link", "Hotels", -1000), ("flight", "link", "Flights", 100), ("flight", "input:text", "From", 90), ("flight", "input:text", "Departure date", 110), ("flight", "listitem", "Goa, to New Delhi", 140),
    ("other", "link", "Tokyo", 90), ("other", "text", "Tokyo", 0), ("other", "option", "A", 70),
]
SHOWN_SQL = "(VALUES " + ", ".join(f"('{kind}', {[x for x in SHOWN if x[0] == kind].index((kind, role, label, score))}, {sum(x[0] == kind for x in SHOWN)}, '{role}', '{label}', {score})" for kind, role, label, score in SHOWN) + ") v(kind, i, many, role, label, score)"


@query(f"""WITH m AS (SELECT p_partkey % 20 AS scan_id, p_partkey AS mark_id, {list(WISHES)}[p_partkey % 20 % 5 + 1] AS kind, p_partkey // 20 AS j FROM part WHERE p_partkey % 17 <> 0),
s AS (SELECT scan_id, mark_id, role, label, score FROM m JOIN {SHOWN_SQL} ON v.kind = m.kind AND j % many = i),
p AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, mark_id) AS place FROM s)
SELECT scan_id, mark_id, role, label, score, place::INT AS place FROM p WHERE place <= 45""")
def ranked_marks(spark, d):
    """The SQL has each score written down; every seventeenth mark is filled already."""
    pages = F.element_at(F.array(*map(F.lit, WISHES)), (F.col("p_partkey") % 20 % 5 + 1).cast("int"))
    shown = F.create_map(*(x for kind in WISHES for x in (F.lit(kind), F.array(*(F.struct(F.lit(r).alias("role"), F.lit(t).alias("label")) for k, r, t, _ in SHOWN if k == kind)))))
    m = table(spark, d, "part").select((F.col("p_partkey") % 20).alias("scan_id"), F.col("p_partkey").alias("mark_id"), F.col("p_partkey").alias("ord"), pages.alias("kind")).withColumn("_l", shown[F.col("kind")])
    m = m.withColumn("_m", F.element_at("_l", (F.floor(F.col("mark_id") / 20) % F.size("_l") + 1).cast("int"))).select("scan_id", "mark_id", "ord", "kind", "_m.*")
    text = F.create_map(*(F.lit(x) for pair in WISHES.items() for x in pair))
    requests = m.select("scan_id", text[F.col("kind")].alias("text")).distinct()
    return marks.rank_marks(requests, m.drop("kind"), m.filter("mark_id % 17 = 0"))


@query(r"""WITH m AS (SELECT p_partkey % 50 AS scan_id, p_partkey AS mark_id, CASE WHEN p_partkey % 4 = 0 THEN 'clickable' ELSE 'link' END AS role,
  lower(CASE p_partkey % 6 WHEN 0 THEN 'Sign in to see ' || p_name WHEN 1 THEN p_name ELSE p_name || ', Rs. ' || p_size * 100 || CASE WHEN p_partkey % 5 = 0 THEN ' sponsored' ELSE '' END || ' ' || (1 + p_size % 4) || '.5 stars' END) AS l, p_partkey % 6 AS k, p_size * 100.0 AS price, 1.5 + p_size % 4 AS rating FROM part),
r AS (SELECT DISTINCT p_partkey % 50 AS scan_id, CASE WHEN p_partkey % 50 % 7 <> 0 THEN 'small widget' END AS q, CASE WHEN p_partkey % 50 % 2 = 0 THEN 2500.0 END AS most, CASE WHEN p_partkey % 50 % 3 = 0 THEN 700.0 END AS least, CASE WHEN p_partkey % 50 % 5 = 0 THEN 3.0 END AS stars, p_partkey % 50 % 4 = 0 AS cheap FROM part),
j AS (SELECT *, (q IS NOT NULL AND contains(l, 'small'))::INT + (q IS NOT NULL AND contains(l, 'widget'))::INT AS held FROM m JOIN r USING (scan_id) WHERE length(l) >= 10 AND k <> 0),
s AS (SELECT *, 100 + 50 * held + CASE WHEN k = 1 THEN 0 ELSE CASE WHEN price > most THEN -500 WHEN most IS NOT NULL THEN 150 + CASE WHEN cheap THEN (most - price) / 10 ELSE 0 END ELSE 0 END + CASE WHEN price < least THEN -300 ELSE 0 END + CASE WHEN rating < stars THEN -500 ELSE rating * 40 END - CASE WHEN p5 THEN 30 ELSE 0 END END AS score
  FROM (SELECT *, mark_id % 5 = 0 AS p5 FROM j) WHERE q IS NULL OR k <> 1 OR held > 0 OR (role = 'link' AND length(l) >= 20)),
o AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, mark_id) AS n FROM s)
SELECT scan_id, mark_id, score::DOUBLE AS score FROM o WHERE n = 1 AND score > 0""")
def page_products(spark, d):
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    priced = F.concat(n, F.lit(", Rs. "), F.col("p_size") * 100, F.when(F.col("p_partkey") % 5 == 0, " sponsored").otherwise(""), F.lit(" "), 1 + F.col("p_size") % 4, F.lit(".5 stars"))
    m = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("scan_id"), F.col("p_partkey").alias("mark_id"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 4 == 0, "clickable").otherwise("link").alias("role"), F.when(k == 0, F.concat(F.lit("Sign in to see "), n)).when(k == 1, n).otherwise(priced).alias("label"))
    s = F.col("scan_id")
    r = m.select("scan_id").distinct().select("scan_id", F.when(s % 7 != 0, "small widget").alias("query"), F.when(s % 2 == 0, 2500.0).alias("max_price"), F.when(s % 3 == 0, 700.0).alias("min_price"), F.when(s % 5 == 0, 3.0).alias("min_rating"), (s % 4 == 0).alias("cheapest"))
    return marks.choose_products(r, m)
