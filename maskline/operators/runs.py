"""Run and event logs: loops, stalls, failures, outages, audits.

The functions over actions take run_id, step, ts, action, target, value, label, ok; those that streams share are built
of the same columns in maskline.streaming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskline.functions import patterns as P
from maskline.functions import scalars as S


def audit_summary(audit: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Entries, bytes, last time, errors and different destinations, counted exactly; streams have an approximate form of it."""
    return audit.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("at").alias("last_at"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_distinct("url").alias("destinations"))


def audit_retention(audit: DataFrame, owner: str, keep: int = 120, images: int = 6) -> DataFrame:
    """Each owner's newest entries; images on the newest few; long texts cut (60000, 240, 200)."""
    place = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("at"), F.desc("entry_id")))
    out = audit.withColumn("_n", place).filter(F.col("_n") <= keep)
    gone = (F.col("_n") > images) & F.col("image").isNotNull()
    out = out.withColumn("image_dropped", gone).withColumn("image", F.when(~gone, F.col("image")))
    return out.withColumns({"body": F.left("body", F.lit(60000)), "task": F.left("task", F.lit(240)), "error": F.left("error", F.lit(200))}).drop("_n")


def recent_runs(history: DataFrame, owner: str, keep: int = 50) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("ts"), F.desc("run_id")))
    return history.withColumn("_n", place).filter(F.col("_n") <= keep).drop("_n")


def signatures(actions: DataFrame) -> DataFrame:
    """actions with sig (type, target, value) and meaning (type, label, value), and what a step adds to a score."""
    text = lambda c, n: F.left(F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))), F.lit(n))
    sig = F.concat_ws("|", F.coalesce("action", F.lit("")), F.coalesce(F.col("target").cast("string"), F.lit("")), text("value", 60))
    meaning = F.concat_ws("|", F.coalesce("action", F.lit("")), text("label", 30), text("value", 60))
    return actions.withColumns({"sig": sig, "meaning": meaning, "weight": F.when(F.coalesce("ok", F.lit(False)), 1.0).otherwise(0.5)})


def detect_loops(actions: DataFrame, limit: float = 2.0) -> DataFrame:
    """run_id, step, score, alert: how often the same was done before a step (done 1, failed 0.5), the larger of both readings."""
    df = signatures(actions)

    def before(c: str) -> Column:
        w = Window.partitionBy("run_id", c).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("weight").over(w), F.lit(0.0))

    score = F.greatest(before("sig"), F.when(F.coalesce("label", F.lit("")) != "", before("meaning")).otherwise(0.0))
    return df.withColumn("score", score).select("run_id", "step", "score", (F.col("score") >= limit).alias("alert"))


def consecutive_duplicates(actions: DataFrame) -> DataFrame:
    """run_id, duplicates (steps like the one before), failed."""
    w = Window.partitionBy("run_id").orderBy("step")
    same = F.lit(True)
    for c in ("action", "target", "value"):
        same &= F.col(c).eqNullSafe(F.lag(c).over(w))
    df = actions.withColumn("_same", same & F.lag("step").over(w).isNotNull())
    return df.groupBy("run_id").agg(F.count_if("_same").alias("duplicates"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"))


def stall_mark() -> Column:
    return F.concat_ws("#", F.coalesce("url", F.lit("")), (F.round(F.coalesce("scroll_y", F.lit(0)) / 100) * 100).cast("int"), F.coalesce("marks", F.lit(0)), F.coalesce("completed", F.lit(0)))


def detect_stalls(steps: DataFrame, limit: int = 4) -> DataFrame:
    """run_id, first_step, repeats: spans in which nothing changed for `limit` steps or more; going elsewhere starts anew."""
    w = Window.partitionBy("run_id").orderBy("step")
    df = steps.withColumn("_m", stall_mark())
    fresh = F.coalesce((F.col("_m") != F.lag("_m").over(w)) | F.coalesce(F.lag("action").over(w) == "navigate", F.lit(False)), F.lit(True))
    df = df.withColumn("_i", F.sum(fresh.cast("int")).over(w))
    return df.groupBy("run_id", "_i").agg(F.min("step").alias("first_step"), (F.count("*") - 1).alias("repeats")).filter(F.col("repeats") >= limit).drop("_i")


def failure_streaks(actions: DataFrame, limit: int = 6) -> DataFrame:
    """run_id, first_step, last_step, failures, stop: runs of failed steps in a row."""
    w = Window.partitionBy("run_id").orderBy("step")
    bad = ~F.coalesce("ok", F.lit(False))
    df = actions.withColumn("_i", F.sum((~bad).cast("int")).over(w)).filter(bad)
    return df.groupBy("run_id", "_i").agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count("*").alias("failures")).withColumn("stop", F.col("failures") >= limit).drop("_i")


def budget_breaches(steps: DataFrame, run_s: int = 600, step_s: int = 60, most: int = 60) -> DataFrame:
    """run_id, seconds, longest, steps of runs over a budget: the run's, a step's, or the number of steps."""
    w = Window.partitionBy("run_id").orderBy("ts", "step")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    out = steps.withColumn("_g", gap).groupBy("run_id").agg((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"), F.coalesce(F.max("_g"), F.lit(0)).alias("longest"), F.count("*").alias("steps"))
    return out.filter((F.col("seconds") > run_s) | (F.col("longest") > step_s) | (F.col("steps") > most))


def debounce(events: DataFrame, key: str, gap: str = "900 milliseconds") -> DataFrame:
    """key, first_at, fires_at, n: bursts of events; one trigger fires when the gap has passed. For tables and streams."""
    return events.groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.min("ts").alias("first_at"), F.count("*").alias("n")).select(key, "first_at", F.col("s.end").alias("fires_at"), "n")


def outage(message: S.ColumnLike = "message") -> Column:
    """Struct of kind and seconds: what an error says of a provider, and for how long it is left alone."""
    t, low = S.col(message), F.lower(S.col(message))
    rate = t.contains("429") | low.contains("rate limit") | low.contains("quota") | low.contains("resource_exhausted")
    auth = t.contains("401") | t.contains("403") | low.contains("api key") | low.contains("unauthor") | low.contains("permission")
    wait = F.coalesce(S.retry_after_seconds(t), F.lit(90.0))
    out = lambda kind, s: F.struct(F.lit(kind).alias("kind"), s.alias("seconds"))
    return F.when(rate, out("rate limited", wait)).when(auth, out("rejected our credentials", F.lit(1800.0))).otherwise(out("erroring", F.lit(30.0)))


def outage_intervals(errors: DataFrame) -> DataFrame:
    """provider, ts, until, kind."""
    df = errors.withColumn("_o", outage())
    return df.select("provider", "ts", (F.col("ts") + F.make_dt_interval(secs=F.col("_o.seconds").cast("decimal(18,6)"))).alias("until"), F.col("_o.kind").alias("kind"))


def unavailable_calls(calls: DataFrame, outages: DataFrame, slot: int = 86_400) -> DataFrame:
    """calls (call_id, provider, ts) with unavailable: whether the latest earlier error's rest was still on.

    As-of by slots of so many seconds: each slot of a provider is one window, which starts from the last error of the slots
    before; so a provider with most rows is split by time. Errors at the same time: the longest rest counts. Null provider
    or time: available.
    """

    def place(df: DataFrame) -> Column:
        local = df.schema["ts"].dataType.typeName() == "timestamp_ntz"  # has no instant, but a day and a time
        seconds = F.unix_date(F.to_date("ts")) * 86_400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts") if local else F.unix_seconds("ts")
        return F.floor(seconds / slot).alias("_slot")

    errors = outages.filter("provider is not null and ts is not null").select("provider", place(outages), "ts", "until", F.lit(0).alias("_call"), F.lit(None).cast(calls.schema["call_id"].dataType).alias("call_id"))
    asked = calls.select("provider", place(calls), "ts", F.lit(None).cast(outages.schema["until"].dataType).alias("until"), F.lit(1).alias("_call"), "call_id")
    both = asked.unionByName(errors)
    latest = both.groupBy("provider", "_slot").agg(F.max(F.when(F.col("_call") == 0, F.struct("ts", "until"))).alias("_l"))
    earlier = Window.partitionBy("provider").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    latest = latest.select("provider", "_slot", F.last("_l", True).over(earlier)["until"].alias("_before"))
    within = Window.partitionBy("provider", "_slot").orderBy("ts", "_call", "until").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.join(latest, ["provider", "_slot"], "left").withColumn("_last", F.coalesce(F.last("until", True).over(within), "_before"))
    return rows.filter("_call = 1").select("call_id", "provider", "ts", F.coalesce(F.col("ts") < F.col("_last"), F.lit(False)).alias("unavailable"))


#: Labels of clicks that do something that can't be taken back (fixed values).
RISKY = (
    r"submit|send\s+message|post\s+comment|publish|confirm\s+order|continue\s+to\s+pay|proceed\s+to\s+(pay|checkout|payment)|finish\s+order|complete\s+order|place\s*order|"
    r"book\s*now|pay\s+now|pay\s+\$|make\s+payment|checkout|check\s*out|buy\s+now|purchase\s+now|order\s+now|add\s+to\s+cart|subscribe\s+now|donate|transfer\s+funds|withdraw|"
    r"deposit\s+funds|billing|upi\s+pay|netbanking|pay\s+with\s+card|delete|remove\s+account|erase|wipe|destroy|discard\s+all|clear\s+all\s+data|deactivate\s+account|"
    r"disable\s+account|cancel\s+subscription|close\s+account|unsubscribe|revoke\s+access|ban\b|permanently\s+delete|create\s+account|sign\s*up\s+now|register\s+now|"
    r"log\s*in\s+now|sign\s*in\s+now|authorize\s+payment|grant\s+access|two-factor|change\s+password|reset\s+password|make\s+public|share\s+with\s+everyone|export\s+all|download\s+all"
)


def click_risk(actions: DataFrame, policy: str = "risky") -> DataFrame:
    """actions with gate_reason (null: goes through)."""
    label = F.trim(F.coalesce("label", F.lit("")))
    return actions.withColumn("gate_reason", F.when(F.lit(policy == "all"), "policy").when(label.rlike(P.java(RISKY, True)), "risky label").when((label == "") & (F.coalesce("role", F.lit("")) != "link"), "no label"))


#: Addresses, widgets and texts of pages that ask for proof of a human (fixed values).
WALL_URL = r"/(?:nocaptcha|captcha|challenge|bot-?check|are-?you-?human|access-?denied|blocked)\b"
WALL_WIDGET = r"(?:<iframe[^>]+src=[\"'][^\"']*(?:recaptcha|hcaptcha|turnstile)|class=[\"'][^\"']*(?:g-recaptcha|h-captcha|cf-turnstile)|id=[\"'](?:challenge-running|[^\"']*cf-challenge))"
WALL_TEXT = r"\b(?:please verify (?:that )?you are (?:a )?human|complete the security check|enable javascript and cookies to continue|automated (?:queries|access)|suspicious activity detected|security verification)\b"


def bot_walls(pages: DataFrame) -> DataFrame:
    """page_id, host, wall (null: none): by address, then widget, then the first 3000 characters of text."""
    h = F.coalesce("html", F.lit(""))
    text = F.left(F.regexp_replace(F.regexp_replace(h, r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]*>", " "), F.lit(3000))
    wall = F.when(F.coalesce(F.try_url_decode("url"), F.col("url")).rlike(P.java(WALL_URL, True)), "address").when(h.rlike("(?i)" + WALL_WIDGET), "widget").when(text.rlike(P.java(WALL_TEXT, True)), "text")
    return pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"), wall.alias("wall"))


def goal_status(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """run_id, satisfied, remaining: rules (wanted, progress) say which progress flag a wanted flag needs.

    runs: run_id, wanted (map of flags), progress (map of flags).
    """
    wanted = runs.select("run_id", F.explode("wanted").alias("wanted", "on"), "progress").filter("on").join(F.broadcast(rules), "wanted")  # rules: a fixed list
    done = F.coalesce(F.element_at("progress", F.col("need")), F.lit(False))
    out = wanted.groupBy("run_id").agg(F.bool_and(done).alias("satisfied"), F.array_sort(F.collect_list(F.when(~done, F.col("wanted")))).alias("remaining"))
    return runs.select("run_id").join(out, "run_id", "left").select("run_id", F.coalesce("satisfied", F.lit(True)).alias("satisfied"), F.coalesce("remaining", F.array().cast("array<string>")).alias("remaining"))


#: Wanted flag -> the progress flag that meets it.
GOALS = {"query": "searched", "filter": "filtered", "sort": "sorted", "cart": "added_to_cart", "open": "opened_target", "scroll": "scrolled", "fill": "filled", "constraint": "constraint_applied"}


def open_target_met(runs: DataFrame) -> DataFrame:
    """runs (targets, opened: arrays) with met: every target was opened. 'first', 'second', … are met by anything opened;
    a name by containment either way, or if all its words of over two letters stand in what was opened."""
    ordinal = r"^(?:the )?(?:first|second|third|fourth|fifth|last|next|\d+(?:st|nd|rd|th))\b"

    def met(t: Column) -> Column:
        words = F.filter(F.split(t, r"[^a-z0-9]+"), lambda w: F.length(w) > 2)

        def by(o: Column) -> Column:
            return F.contains(o, t) | (F.contains(t, o) & (o != "")) | ((F.size(words) > 0) & F.forall(words, lambda w: F.contains(o, w)))

        return F.when(t.rlike(ordinal), F.size("opened") > 0).otherwise(F.exists(F.transform("opened", lambda o: F.lower(F.trim(o))), by))

    return runs.withColumn("met", F.forall(F.transform("targets", lambda t: F.lower(F.trim(t))), met))


#: The forms that a portal takes (fixed values).
FORMS = ("hr", "payroll", "it", "housing", "medical")


def messages_view(messages: DataFrame, initials: str | None = None, key: Column | None = None) -> DataFrame:
    """Messages that a person may see: theirs, and those that nobody is named for; without initials all of them.

    With a key, text is the plain form of ciphertext (a mark where that fails). messages: emp_initials, ciphertext."""
    rows = messages
    if initials:
        rows = rows.filter((F.col("emp_initials") == initials) | F.coalesce(F.col("emp_initials"), F.lit("")).isin(""))
    if key is None:
        return rows
    from maskline.operators.redact import decrypt_columns

    return decrypt_columns(rows.withColumn("text", F.col("ciphertext")), ["text"], key)


CHANGES = ["kind", "emp", "form_id", "at", "seq"]


def compact_changes(changes: DataFrame, allowed: tuple[str, ...] = FORMS) -> DataFrame:
    """Of each person and form the last submission, of each person the last deletion, and the last deletion of all.

    changes: kind (submit, delete), emp (null for a delete: everyone), form_id, at, seq (order of equal times). Unknown forms and
    submissions without a person or time go. The compact form of two parts together is that of their compact forms."""
    sound = (F.col("kind") == "submit") & F.col("form_id").isin(*allowed) & F.col("emp").isNotNull() | (F.col("kind") == "delete")
    rows = changes.filter(sound & F.col("at").isNotNull()).withColumn("form_id", F.when(F.col("kind") == "submit", F.col("form_id")))
    return rows.groupBy("kind", "emp", "form_id").agg(F.max(F.struct("at", "seq")).alias("_t")).select("kind", "emp", "form_id", "_t.at", "_t.seq")


def forms_latest(changes: DataFrame, allowed: tuple[str, ...] = FORMS) -> DataFrame:
    """emp, form_id, submitted_at: the last submission of each, unless a later deletion of the person's or of all forms follows it."""
    rows = compact_changes(changes, allowed)
    when = F.struct("at", "seq")
    gone = rows.filter("kind = 'delete'")
    one = gone.filter("emp is not null").select("emp", when.alias("_one"))
    every = F.broadcast(gone.filter("emp is null").agg(F.max(when).alias("_all")))  # one row
    kept = rows.filter("kind = 'submit'").select("emp", "form_id", when.alias("_t")).join(one, "emp", "left").crossJoin(every)
    return kept.filter("(_one is null or _t > _one) and (_all is null or _t > _all)").select("emp", "form_id", F.col("_t.at").alias("submitted_at"))


def person_overview(missions: DataFrame, messages: DataFrame) -> DataFrame:
    """emp_id, n_missions, n_messages."""
    m = missions.filter("emp_id is not null").groupBy("emp_id").agg(F.count("*").alias("n_missions"))
    n = messages.filter("emp_id is not null").groupBy("emp_id").agg(F.count("*").alias("n_messages"))
    return m.join(n, "emp_id", "full").fillna(0, ["n_missions", "n_messages"])
