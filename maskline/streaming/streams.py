"""The log operators on streams: the same columns as the batch forms, with watermarks and keyed state.

Late rows, by more than LATE, are dropped; metrics.StreamCounts writes how many, by query and operator, to a table.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from maskline.operators import egress, runs
from maskline.plans.session import ship

LATE = "10 minutes"
TTL_MS = 600_000


def audit_spans(audit: DataFrame, every: str = "1 hour") -> DataFrame:
    """span, n, bytes, errors, destinations for each span of `at`."""
    spans = audit.withWatermark("at", LATE).groupBy(F.window("at", every).alias("span"))
    return spans.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.approx_count_distinct("url", 0.01).alias("destinations"))


def gated(payloads: DataFrame) -> DataFrame:
    """Payloads with their block_reason; stateless."""
    return egress.egress_gate(payloads)


def write_gated(payloads: DataFrame, allowed: str, quarantine: str, checkpoint: str):
    """Starts a query that deals payloads out to two Parquet folders."""

    def sink(batch: DataFrame, number: int) -> None:
        out = egress.egress_gate(batch).withColumn("batch", F.lit(number))
        out.filter("block_reason is null").drop("block_reason").write.mode("append").parquet(allowed)
        out.filter("block_reason is not null").write.mode("append").parquet(quarantine)

    return payloads.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gate_totals(payloads: DataFrame) -> DataFrame:
    """gated() that also observes, as "gate", how many payloads and bytes passed by and how many were blocked."""
    return gated(payloads).observe("gate", F.count("*").alias("payloads"), F.count_if(F.col("block_reason").isNotNull()).alias("blocked"), F.sum("bytes").alias("bytes"))


def gate_metrics(payloads: DataFrame, every: str = "1 hour") -> DataFrame:
    return egress.gate_metrics(egress.egress_gate(payloads).withWatermark("ts", LATE), every)


def keep_forms(changes: DataFrame, path: str, checkpoint: str):
    """Starts a query that folds changes (see runs.compact_changes) into a table: each batch writes the compact state anew, under the
    batch's number, so that a batch that is run again gives the same. Read it by runs.forms_latest(latest_forms(...))."""

    def fold(batch: DataFrame, number: int) -> None:
        before = latest_forms(batch.sparkSession, path, number)
        rows = batch.select(*runs.CHANGES)
        runs.compact_changes(rows if before is None else before.unionByName(rows)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_forms(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The compact state that the last batch (before the given one) wrote; None if there is none."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(top)] if files.exists(top) else []
    numbers = [int(n[6:]) for n in names if n.startswith("batch=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    numbers = [n for n in numbers if before is None or n < before]
    return spark.read.parquet(f"{path}/batch={max(numbers)}") if numbers else None


def debounce(events: DataFrame, key: str, gap: str = "900 milliseconds") -> DataFrame:
    return runs.debounce(events.withWatermark("ts", LATE), key, gap)


LOOPS = "run_id string, step long, score double, alert boolean"


def detect_loops(actions: DataFrame, limit: float = 2.0) -> DataFrame:
    """run_id, step, score, alert, as runs.detect_loops: a run's scores are kept until ten minutes after its last step.

    actions need ts; the steps of a run have to arrive in order.
    """
    ship(actions.sparkSession)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        scores = dict(zip(*state.get)) if state.exists else {}
        for rows in batches:
            rows, out = rows.sort_values("step"), []
            for step, sig, meaning, label, weight in rows[["step", "sig", "meaning", "label", "weight"]].itertuples(index=False):
                score = max(scores.get(f"s{sig}", 0.0), scores.get(f"m{meaning}", 0.0) if label else 0.0)
                out.append((str(key[0]), step, score, score >= limit))
                for k in (f"s{sig}", f"m{meaning}"):
                    scores[k] = scores.get(k, 0.0) + weight
            yield pd.DataFrame(out, columns=["run_id", "step", "score", "alert"])
        state.update((list(scores), list(scores.values())))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + TTL_MS)

    df = runs.signatures(actions).withWatermark("ts", LATE)
    df = df.select(F.col("run_id").cast("string").alias("run_id"), F.col("step").cast("long").alias("step"), "sig", "meaning", F.coalesce("label", F.lit("")).alias("label"), "weight", "ts")
    return df.groupBy("run_id").applyInPandasWithState(update, LOOPS, "keys array<string>, scores array<double>", "append", GroupStateTimeout.EventTimeTimeout)


STREAKS = "run_id string, step long, repeats long, failures long"


def detect_streaks(actions: DataFrame) -> DataFrame:
    """run_id, step, repeats (of an unchanged screen so far), failures (in a row so far); one row for each step.

    actions: run_id, step, ts, ok, mark (of the screen, see runs.stall_mark), action.
    """
    ship(actions.sparkSession)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, repeats, failures, moved = state.get if state.exists else (None, 0, 0, False)
        for rows in batches:
            out = []
            for step, mark, ok, action in rows.sort_values("step")[["step", "mark", "ok", "action"]].itertuples(index=False):
                repeats = repeats + 1 if mark == last and not moved else 0
                failures = 0 if ok else failures + 1
                last, moved = mark, action == "navigate"
                out.append((str(key[0]), step, repeats, failures))
            yield pd.DataFrame(out, columns=["run_id", "step", "repeats", "failures"])
        state.update((last, repeats, failures, moved))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + TTL_MS)

    df = actions.withWatermark("ts", LATE).select(F.col("run_id").cast("string").alias("run_id"), F.col("step").cast("long").alias("step"), F.coalesce("mark", F.lit("")).alias("mark"), F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("action", F.lit("")).alias("action"), "ts")
    return df.groupBy("run_id").applyInPandasWithState(update, STREAKS, "last string, repeats long, failures long, moved boolean", "append", GroupStateTimeout.EventTimeTimeout)


def outage_intervals(errors: DataFrame) -> DataFrame:
    """provider, ts, until, kind of each error; stateless."""
    return runs.outage_intervals(errors)


RESTS = "call_id long, provider string, ts timestamp, unavailable boolean"


class Rests(StatefulProcessor):
    """A provider's errors and its calls that wait until the watermark has passed them: then no error before them can still come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.errors = handle.getListState("errors", "ts long, until long")
        self.calls = handle.getListState("calls", "call_id long, ts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        errors, calls, timers = [], [], set()
        for df in rows:
            for call, ts, until in df[["call_id", "us", "until_us"]].itertuples(index=False):
                if pd.isna(until):
                    calls.append((int(call), int(ts)))
                    timers.add(int(ts) // 1000 + 1)
                else:
                    errors.append((int(ts), int(until)))
                    timers.add(max(int(ts), int(until)) // 1000 + 1)
        if errors:
            self.errors.appendList(errors)
        if calls:
            self.calls.appendList(calls)
        for t in timers:
            self.handle.registerTimer(t)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Answers the calls before the watermark, and forgets what can't matter any more: at the rest's end, everything."""
        now, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        errors, calls = sorted(self.errors.get()), sorted(self.calls.get(), key=lambda c: c[1])
        starts = [e[0] for e in errors]
        for call, ts in calls:
            if ts >= now:
                break
            k = bisect_right(starts, ts)
            out.append((call, key[0], pd.Timestamp(ts, unit="us"), k > 0 and ts < errors[k - 1][1]))
        wait = [(c, ts) for c, ts in calls if ts >= now]
        last = bisect_left(starts, now) - 1  # the latest error before the watermark: its rest still counts, if it isn't over
        keep = [e for i, e in enumerate(errors) if i > last or i == last and e[1] > now]
        for state, before, after in ((self.calls, calls, wait), (self.errors, errors, keep)):
            if len(after) < len(before):
                state.put(after) if after else state.clear()
        if out:
            yield pd.DataFrame(out, columns=["call_id", "provider", "ts", "unavailable"])

    def close(self) -> None:
        pass


def unavailable_calls(errors: DataFrame, calls: DataFrame, parts: int = 8) -> DataFrame:
    """call_id, provider, ts, unavailable, as runs.unavailable_calls, of streams of errors (provider, ts, message) and calls (call_id, provider, ts).

    A call is answered once the watermark has passed it, so that rows may come in any order within LATE. A provider's calls are dealt
    out to `parts` keys and its errors, which are few, sent to each; state is kept until the last rest is over. Calls without a
    provider or time have no state and no answer. The session must keep state in RocksDB
    (spark.sql.streaming.stateStore.providerClass)."""
    ship(errors.sparkSession)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rest = runs.outage_intervals(errors.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)).select("provider", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "ts", us("ts").alias("us"), us("until").alias("until_us"), F.lit(None).cast("long").alias("call_id"))
    asked = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).select("provider", F.pmod(F.xxhash64("call_id"), F.lit(parts)).cast("int").alias("part"), "ts", us("ts").alias("us"), F.lit(None).cast("long").alias("until_us"), F.col("call_id").cast("long").alias("call_id"))
    both = rest.unionByName(asked).filter("provider is not null and us is not null")
    return both.groupBy("provider", "part").transformWithStateInPandas(Rests(), RESTS, "Append", "EventTime")
