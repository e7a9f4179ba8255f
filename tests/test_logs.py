"""Run logs in batch and as streams, facets and sources."""

import json

import pytest
from pyspark.sql import functions as F

from maskline.operators import facets, runs
from maskline.plans import catalog
from maskline.sources import io
from maskline.streaming import streams

SF = "/root/testdata/sf0.001"


def streamed(spark, df, tmp_path, make, name, mode="append"):
    """The rows of a streaming form over df, fed as two files."""
    src = str(tmp_path / name)
    df.repartition(1).sortWithinPartitions("ts" if "ts" in df.columns else "at").write.parquet(src)
    q = make(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


@pytest.fixture(scope="module")
def steps(spark):
    return catalog.steps(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")).cache()


def test_loops_in_a_stream(spark, steps, tmp_path):
    got = streamed(spark, steps, tmp_path, streams.detect_loops, "loops")
    want = runs.detect_loops(steps).collect()
    assert sorted((int(r["run_id"]), r["step"], r["score"], r["alert"]) for r in got) == sorted((r["run_id"], r["step"], r["score"], r["alert"]) for r in want)


def test_streaks_in_a_stream(spark, steps, tmp_path):
    df = steps.withColumn("mark", F.col("action"))
    got = streamed(spark, df, tmp_path, streams.detect_streaks, "streaks")
    ends = {(int(r["run_id"]), r["step"]): r["failures"] for r in got}
    for r in runs.failure_streaks(steps, 3).collect():
        assert ends[r["run_id"], r["last_step"]] == r["failures"]


def test_bursts_in_a_stream(spark, steps, tmp_path):
    df = steps.select("run_id", "ts")
    last = df.agg(F.max("ts")).first()[0]
    got = streamed(spark, df, tmp_path, lambda s: streams.debounce(s, "run_id", "1 hour"), "bursts")
    want = [r for r in runs.debounce(df, "run_id", "1 hour").collect()]
    closed = [r for r in want if (last - r["fires_at"]).total_seconds() > 601]
    have = {(r["run_id"], r["first_at"], r["n"]) for r in got}
    assert {(r["run_id"], r["first_at"], r["n"]) for r in closed} <= have <= {(r["run_id"], r["first_at"], r["n"]) for r in want}


def test_gate_in_a_stream(spark, tmp_path):
    df = catalog.payloads(spark, SF)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.write_gated(stream, str(tmp_path / "ok"), str(tmp_path / "held"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    held = catalog.gated_payloads(spark, SF).filter("block_reason is not null").count()
    assert spark.read.parquet(str(tmp_path / "held")).count() == held and spark.read.parquet(str(tmp_path / "ok")).count() == df.count() - held


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_calls_in_outages_in_a_stream(spark, tmp_path, rocksdb):
    """Rows out of order within a file and over files; a last one, far on, moves the watermark past all others."""
    import random
    from datetime import datetime, timedelta

    draw, begin = random.Random(9), datetime(2024, 1, 1)
    moment = lambda: begin + timedelta(milliseconds=draw.randrange(7_200_000))
    errors = [(draw.choice("abc"), moment(), draw.choice(["429 try again in 1m2.5s", "401", "boom", "Quota exceeded"])) for _ in range(60)]
    calls = [(i, draw.choice(["a", "b", "c", "d", None]), moment() if i % 40 else None) for i in range(400)]
    e, c = spark.createDataFrame(errors, "provider string, ts timestamp, message string"), spark.createDataFrame(calls, "call_id long, provider string, ts timestamp")
    want = {r["call_id"]: r["unavailable"] for r in runs.unavailable_calls(c, runs.outage_intervals(e)).filter("provider is not null and ts is not null").collect()}
    end = begin + timedelta(days=3)
    for i, (lo, hi) in enumerate(((0, 1200), (1200, 7200))):
        span = F.unix_seconds("ts") - int(begin.timestamp())
        within = (span >= lo) & (span < hi) | F.lit(i == 1) & F.col("ts").isNull()
        e.filter(within).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        c.filter(within).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
        stream = lambda name, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        if i == 1:
            spark.createDataFrame([("z", end, "boom")], e.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
            spark.createDataFrame([(-1, "z", end)], c.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
        q = streams.unavailable_calls(stream("e", e), stream("c", c), 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["call_id"]: r["unavailable"] for r in got} == want and len(got) == len(want)
    state = q.lastProgress.stateOperators[0]
    assert state.numRowsTotal <= 20  # of 450 rows: the last error, its timers, and the last call


def test_late_rows_are_counted(spark, tmp_path):
    from datetime import datetime, timedelta

    from maskline.streaming.metrics import StreamCounts, totals

    begin = datetime(2024, 1, 1)
    counts = StreamCounts(spark, str(tmp_path / "counts"))
    spark.streams.addListener(counts)
    try:
        for k, minutes in enumerate(([0, 1, 60], [61, 2, 3, 62, 30])):  # the watermark of the second file's batch: minute 50
            spark.createDataFrame([(begin + timedelta(minutes=m), "u", 5, None) for m in minutes], "at timestamp, url string, bytes long, error string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            df = spark.readStream.schema("at timestamp, url string, bytes long, error string").parquet(str(tmp_path / "in"))
            q = streams.audit_spans(df, "1 minute").writeStream.queryName("spans").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination(120)
        pay = catalog.payloads(spark, SF)
        pay.coalesce(1).write.parquet(str(tmp_path / "pay"))
        q = streams.gate_totals(spark.readStream.schema(pay.schema).parquet(str(tmp_path / "pay"))).writeStream.queryName("gate").format("noop").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        import time

        for _ in range(100):
            got = {(r["query"], r["kind"], r["metric"]): r["value"] for r in totals(spark.read.parquet(str(tmp_path / "counts"))).collect()} if (tmp_path / "counts").exists() else {}
            if len(got) == 4:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counts)
    blocked = catalog.gated_payloads(spark, SF).agg(F.count("*").alias("n"), F.count_if(F.col("block_reason").isNotNull()).alias("b"), F.sum("bytes").alias("s")).first()
    assert got == {("spans", "late", "dropped"): 3.0, ("gate", "observed", "payloads"): blocked["n"], ("gate", "observed", "blocked"): blocked["b"], ("gate", "observed", "bytes"): blocked["s"]}


def test_stalls_and_budgets(spark):
    rows = [(1, i, "u", 10, 5, 0, "click") for i in range(6)] + [(2, i, "u", 1000 * i, 5, 0, "scroll") for i in range(6)]
    df = spark.createDataFrame(rows, "run_id int, step int, url string, scroll_y int, marks int, completed int, action string")
    assert [(r["run_id"], r["first_step"], r["repeats"]) for r in runs.detect_stalls(df).collect()] == [(1, 0, 5)]


def test_outage_kinds(spark):
    rows = [("429 Too Many Requests", "rate limited", 90.0), ("Rate limit: try again in 2m10s", "rate limited", 135.0), ("401", "rejected our credentials", 1800.0), ("boom", "erroring", 30.0)]
    df = spark.createDataFrame(rows, "message string, kind string, seconds double").withColumn("o", runs.outage())
    assert all((r["o"]["kind"], r["o"]["seconds"]) == (r["kind"], r["seconds"]) for r in df.collect())


def test_goals_and_targets(spark):
    df = spark.createDataFrame([(1, {"query": True, "sort": True}, {"searched": True}), (2, {"query": False}, {})], "run_id int, wanted map<string,boolean>, progress map<string,boolean>")
    rules = spark.createDataFrame(list(runs.GOALS.items()), "wanted string, need string")
    assert {r["run_id"]: (r["satisfied"], r["remaining"]) for r in runs.goal_status(df, rules).collect()} == {1: (False, ["sort"]), 2: (True, [])}
    t = spark.createDataFrame([(1, ["first result"], ["x"]), (2, ["Blue Shoes"], ["nice blue running shoes"]), (3, ["hat"], ["cap"])], "run_id int, targets array<string>, opened array<string>")
    assert {r["run_id"]: r["met"] for r in runs.open_target_met(t).collect()} == {1: True, 2: True, 3: False}


def test_walls_and_clicks(spark):
    pages = spark.createDataFrame([(1, "https://a.b/captcha", ""), (2, "https://a.b/", "<iframe src='https://x/recaptcha/y'>"), (3, "https://a.b/", "<p>Please verify you are human</p>"), (4, "https://a.b/", "<p>fine</p>")], "page_id int, url string, html string")
    assert {r["page_id"]: r["wall"] for r in runs.bot_walls(pages).collect()} == {1: "address", 2: "widget", 3: "text", 4: None}
    a = spark.createDataFrame([("Place order", "button"), ("Read more", "link"), ("", "button"), ("", "link")], "label string, role string")
    assert [r["gate_reason"] for r in runs.click_risk(a).collect()] == ["risky label", None, "no label", None]


def test_calls_in_outages_by_slots(spark):
    import random

    rnd, times = random.Random(3), lambda n: [(f"p{rnd.randrange(2)}" if rnd.random() < 0.9 else None, rnd.randrange(300) if rnd.random() < 0.95 else None) for _ in range(n)]
    errors, asked = [(p, t, t + rnd.randrange(60)) for p, t in times(60) if t is not None], times(200)
    c = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(asked)], "call_id long, provider string, s long").select("call_id", "provider", F.timestamp_seconds("s").alias("ts"))
    o = spark.createDataFrame(errors, "provider string, s long, u long").select("provider", F.timestamp_seconds("s").alias("ts"), F.timestamp_seconds("u").alias("until"))

    def off(p, t):
        before = [(s, u) for q, s, u in errors if p is not None and t is not None and q == p and s <= t]
        return bool(before) and t < max(before)[1]

    want = {i: off(p, t) for i, (p, t) in enumerate(asked)}
    for slot in (7, 50, 100_000):
        assert {r["call_id"]: r["unavailable"] for r in runs.unavailable_calls(c, o, slot).collect()} == want
    assert runs.unavailable_calls(c.limit(0), o).isEmpty() and not runs.unavailable_calls(c, o.limit(0)).filter("unavailable").count()


def test_request_facets(spark):
    rows = [(1, "search for red shoes under 2k and show me the results please"), (2, "book a flight from New Delhi to Goa on Friday"), (3, "hello"), (4, None)]
    sought = {"Look up 'blue kettle' thanks!": "blue kettle", "search for salt and pepper mill and open the first": "salt and pepper mill", "please search lamps, then tell me": "lamps", "search for it": None, "search tents please, show me the prices.": "tents", "search for maps then also check one and buy it": "maps", "go and search for cots ,  book it; -": "cots", "search for fans -": "fans"}
    rows += [(10 + i, t) for i, t in enumerate(sought)]
    got = {r["id"]: r for r in facets.request_facets(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert [got[10 + i]["query"] for i in range(len(sought))] == list(sought.values())
    assert (got[1]["query"], got[1]["max_price"]) == ("red shoes under 2k", 2000.0)
    assert (got[2]["category"], got[2]["from_city"], got[2]["to_city"]) == ("flights", "New Delhi", "Goa") and got[3]["query"] is None is got[4]["query"]


def test_fields_and_replies(spark):
    f = spark.createDataFrame([(1, 7, "First Name", "input:text"), (1, 7, "Passport no", "input:text"), (1, 7, "", "input:email"), (1, 7, "Shoe size", "input:text")], "form_id int, subject_id int, label string, role string")
    assert [r["key"] for r in facets.map_fields(f).collect()] == ["first_name", "unknown", "email", "shoe_size"]
    v = spark.createDataFrame([(7, "first_name", "A"), (7, "email", "e")], "subject_id int, key string, value string")
    (r,) = facets.fill_plan(f, v).collect()
    assert (r["fillable"], r["missing"]) == (2, ["shoe_size", "unknown"])
    texts = [('{"action": "a"}', "strict"), ('ok {"action": "a"} end', "inside"), ("{'action': 'a'}", "quotes"), ("{action: 'a'}", "keys"), ("action: 'a', target: 'b", "fields"), ("??", "none"), (None, "none")]
    got = facets.repair_json(spark.createDataFrame(texts, "text string, want string")).collect()
    assert all(r["how"] == r["want"] and r["reply"]["action"] == ("done" if r["want"] == "none" else "a") for r in got)


def test_field_keys(spark):
    want = {"Satellite Name": "satellite_name", "Operator on duty": "operator", "TLE line 2": "tle_line_2", "Annual salary": "annual_income", "Date of birth": "dob", "User ID": "username", "PIN": "password", "PIN code": "zip", "Postcode": "address",
            "Full name": "name", "Surname": "last_name", "Town": "city", "PAN": "unknown", "Card number": "unknown", "Shoe  size!": "shoe_size", "": None}
    f = spark.createDataFrame([(k, "input:text") for k in want], "label string, role string")
    assert {r["label"]: r["key"] for r in facets.map_fields(f).collect()} == want
    f = spark.createDataFrame([("Name", "input:email"), ("Aadhaar", "input:tel"), (None, "input:tel"), (None, None)], "label string, role string")
    assert [r["key"] for r in facets.map_fields(f).collect()] == ["email", "unknown", "phone", None]


def test_marks(spark):
    marks = spark.createDataFrame([(1, 1, "input:search", "Search products", 0, 10, 50, 10), (1, 2, "link", "About", 0, 30, 50, 10)], "scan_id int, mark_id int, role string, label string, x int, y int, w int, h int").withColumn("viewport_height", F.lit(800))
    tasks = spark.createDataFrame([(1, 1, "search products", "search")], "scan_id int, task_id int, text string, kind string")
    ocr = spark.createDataFrame([(1, 0, 10, 50, 10, "Search products")], "scan_id int, x int, y int, w int, h int, text string")
    assert [(r["mark_id"], r["score"], r["place"]) for r in facets.ground_candidates(tasks, marks, ocr).collect()] == [(1, 1.0, 1)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert [(r["file"], r["text"]) for r in io.read_documents(spark, str(tmp_path / "a.txt")).collect()] == [("a.txt", "one\ntwo")]
    (tmp_path / "s.jsonl").write_text('{"timestamp": "2024-01-01T00:00:00Z", "event": "e", "data": {"k": 1, "w": [5, {"z": "y"}]}}\n\n{"timestamp": 3, "event": "f"}\n{"event": \n[1]\n')
    log = io.read_session_log(spark, str(tmp_path / "s.jsonl"))
    got = io.data_fields(log, {"k": ("$.k", "int"), "z": ("$.w[1].z", "string"), "bad": ("$.w", "int")}).select("event", "k", "z", "bad", "malformed", F.col("timestamp").isNull().alias("t")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("e", 1, "y", None, None, False), ("f", None, None, None, None, True), (None, None, None, None, '{"event": ', True), (None, None, None, None, "[1]", True)], key=repr)
    assert io.divided_log(log, str(tmp_path / "held")).count() == 2 and spark.read.text(str(tmp_path / "held")).count() == 2
    state = {"missions": [{"mission_id": 1, "empId": "a", "other": 2}], "messages": [{"id": "2", "empInitials": "AB", "from": "x"}], "forms": {"AB_hr": "2024-01-01T00:00:00Z", "C_D_it": "bad"}}
    for text, sizes in ((json.dumps(state), (1, 1, 2)), ('{"missions": [], "messages": [], "forms": {}}', (0, 0, 0)), ("{}", (0, 0, 0)), ("not json", (0, 0, 0)), ("", (0, 0, 0))):
        (tmp_path / "p.json").write_text(text)
        out = io.read_portal_state(spark, str(tmp_path / "p.json"))
        assert tuple(out[k].count() for k in ("missions", "messages", "forms")) == sizes, text
        if sizes[0]:
            assert {(r["emp"], r["form_id"], r["submitted_at"] is None) for r in out["forms"].collect()} == {("AB", "hr", False), ("C_D", "it", True)}
            assert out["missions"].first()["emp_id"] == "a" and out["messages"].first()["sender"] == "x"
    pages = spark.createDataFrame([(1, "<div class='classified'><p>x</p></div><form><input type=email name=mail><input type=search></form><a href='/q'>Go</a>")], "page_id long, html string")
    e = io.page_elements(pages).cache()
    assert [r["role"] for r in e.filter("role <> 'text'").orderBy("ord").collect()] == ["input:email", "input:search", "link"]
    from maskline.operators.discover import sensitive_inputs

    assert [r["name"] for r in sensitive_inputs(e).collect()] == ["mail"] and io.classified_containers(e).count() == 1
    assert {r["safe_label"] for r in io.safe_labels(e).filter("tag = 'a'").collect()} == {"go"}


def test_messages_and_forms(spark, tmp_path):
    m = spark.createDataFrame([("a", "NK", "x"), ("b", None, "y"), ("c", "", "z"), ("d", "RV", "w")], "id string, emp_initials string, ciphertext string")
    assert sorted(r["id"] for r in runs.messages_view(m, "NK").collect()) == ["a", "b", "c"] and runs.messages_view(m).count() == 4
    assert {r["text"] for r in runs.messages_view(m, "NK", F.lit("0" * 32).cast("binary")).collect()} == {"[decryption failed]"}
    import random
    from datetime import datetime, timedelta

    draw, begin = random.Random(8), datetime(2024, 1, 1)
    rows = [(draw.choice(["submit"] * 9 + ["delete"]), draw.choice(["a", "b", "c", "d"]), draw.choice([*runs.FORMS, "leave", None]), begin + timedelta(hours=draw.randrange(200)), i) for i in range(300)]
    rows += [("delete", None, None, begin + timedelta(hours=120), 900), ("submit", None, "hr", begin, 901), ("submit", "a", "hr", None, 902)]
    kept: dict = {}
    for kind, emp, form, at, _ in sorted((r for r in rows if r[3]), key=lambda r: (r[3], r[4])):
        if kind == "delete":
            kept = {k: v for k, v in kept.items() if emp is not None and k[0] != emp}
        elif emp and form in runs.FORMS:
            kept[emp, form] = at
    df = spark.createDataFrame(rows, "kind string, emp string, form_id string, at timestamp, seq long")
    read = lambda state: {(r["emp"], r["form_id"]): r["submitted_at"] for r in runs.forms_latest(state).collect()}
    assert read(df) == kept and read(df.limit(0)) == {}
    assert streams.latest_forms(spark, str(tmp_path / "state")) is None
    for part in df.randomSplit([1.0, 1.0, 1.0], 3):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.keep_forms(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(120)
    state = streams.latest_forms(spark, str(tmp_path / "state"))
    assert read(state) == kept and state.count() < 40


def test_nearest_ranks(spark):
    """Ties, one value, huge spreads, nulls, NaN and null keys, against sorting; few buckets, so that ranges narrow often."""
    import math
    import random

    from maskline.operators.ranks import nearest_ranks

    draw, rows = random.Random(2), []
    for g, values in {"ties": [1.0, 2.0, 2.0, 2.0, 3.0] * 9, "one": [5.0], "wide": [draw.choice([-1, 1]) * 10.0 ** draw.randint(-300, 300) for _ in range(90)], None: [draw.random() for _ in range(70)], "odd": [math.nan, math.inf, None, 4.0], "none": [None], "ends": [-1.7e308, 1.7e308, 0.0]}.items():
        rows += [(g, v) for v in values]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {}
    for g in {r[0] for r in rows}:
        v = sorted(x for k, x in rows if k == g and x is not None and math.isfinite(x))
        if v:
            want[g] = (len(v), *(v[max(math.ceil(p * len(v)), 1) - 1] for p in (0.0, 0.5, 0.95, 1.0)))
    shares = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}
    for buckets in (3, 1024):
        assert {r["g"]: tuple(r)[1:] for r in nearest_ranks(df, ["g"], "v", shares, buckets).collect()} == want
    everything = sorted(v for _, v in rows if v is not None and math.isfinite(v))
    assert tuple(nearest_ranks(df, [], "v", {"m": 0.5}).first()) == (len(everything), everything[math.ceil(len(everything) / 2) - 1])
    assert nearest_ranks(df.limit(0), ["g"], "v", shares).collect() == []


def test_replies_are_read_once_a_form(spark):
    df = spark.createDataFrame([("{'action': 'a'}",), (None,)], "text string")
    out = facets.repair_json(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("get_json_object(") == 4
    assert [(r["how"], r["reply"]["action"]) for r in out.collect()] == [("quotes", "a"), ("none", "done")]
