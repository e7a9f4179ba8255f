"""How good detection is: matches against truth, rates, coverage, stability and latency."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.operators.ranks import nearest_ranks
from maskline.functions.groups import kept_rows
from maskline.sources.tables import stored

from .regions import overlap_pairs


def match_detections(truth: DataFrame, pred: DataFrame, scan: str = "scan_id", least: float = 0.5, cell: int = 64) -> DataFrame:
    """scan, a_id, b_id, covered, iou: greedy one-to-one matches of truth boxes (a) and predictions (b).

    Pairs that cover `least` of the truth box are taken by falling coverage, then IoU, then ids. A scan is one screen: its
    candidate pairs are gone through by one task. cell: see overlap_pairs().
    """
    pairs = overlap_pairs(truth, pred, scan, "ord", "ord", cell).filter(F.col("covered") >= least)

    def choose(p: dict[str, np.ndarray]) -> list[int]:
        mine, its, kept = set(), set(), []
        for i, (a, b) in enumerate(zip(p["a_id"].tolist(), p["b_id"].tolist())):
            if a not in mine and b not in its:
                mine.add(a), its.add(b), kept.append(i)
        return kept

    rows = pairs.select(scan, "a_id", "b_id", "covered", "iou")
    return kept_rows(rows, scan, [F.desc("covered"), F.desc("iou"), F.col("a_id"), F.col("b_id")], choose, ["a_id", "b_id"])


def detection_quality(truth: DataFrame, pred: DataFrame, safe: DataFrame, scan: str = "scan_id", cell: int = 64) -> DataFrame:
    """scan, n_truth, n_pred, tp, harmful (unmatched predictions over half a safe box), recall, precision, mean_iou. cell: see overlap_pairs()."""
    matches = stored(match_detections(truth, pred, scan, cell=cell), "matches")  # read twice
    tp = matches.groupBy(scan).agg(F.count("*").alias("tp"), F.avg("iou").alias("mean_iou"))
    free = pred.join(matches.select(scan, F.col("b_id").alias("ord")), [scan, "ord"], "left_anti")
    harmful = overlap_pairs(safe, free, scan, "ord", "ord", cell).filter("covered >= 0.5").select(scan, "b_id").distinct().groupBy(scan).agg(F.count("*").alias("harmful"))
    n = truth.groupBy(scan).agg(F.count("*").alias("n_truth")).join(pred.groupBy(scan).agg(F.count("*").alias("n_pred")), scan, "full")
    out = n.join(tp, scan, "left").join(harmful, scan, "left").fillna(0, ["n_truth", "n_pred", "tp", "harmful"])
    return out.withColumn("recall", F.try_divide("tp", "n_truth")).withColumn("precision", F.try_divide(F.col("tp"), F.col("tp") + F.col("harmful")))


def covered_by(truth: DataFrame, pred: DataFrame, scan: str = "scan_id", least: float = 0.5, cell: int = 64) -> DataFrame:
    """scan, ord, sources: which sources reach each truth box."""
    hits = overlap_pairs(truth, pred, scan, "ord", "ord", cell).filter(F.col("covered") >= least)
    hits = hits.join(pred.select(scan, F.col("ord").alias("b_id"), "source"), [scan, "b_id"]).groupBy(scan, F.col("a_id").alias("ord")).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return truth.select(scan, "ord").join(hits, [scan, "ord"], "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def source_counts(covered: DataFrame) -> DataFrame:
    """Counts of truth boxes by source, by one source alone, and by none."""
    has = lambda s: F.array_contains("sources", s)
    return covered.agg(
        F.count_if(has("dom")).alias("dom"), F.count_if(has("vision_ocr")).alias("ocr"), F.count_if(has("vision_face")).alias("face"),
        F.count_if(has("vision_ocr") & (F.size("sources") == 1)).alias("only_ocr"), F.count_if(has("vision_face") & (F.size("sources") == 1)).alias("only_face"), F.count_if(F.size("sources") == 0).alias("uncovered"),
    )


def mask_area(truth: DataFrame, pred: DataFrame, viewport: int, scan: str = "scan_id") -> DataFrame:
    """scan, truth_area, masked_area, share (of the viewport), inflation."""
    area = lambda name: F.sum(F.col("w").cast("long") * F.col("h")).alias(name)
    out = truth.groupBy(scan).agg(area("truth_area")).join(pred.groupBy(scan).agg(area("masked_area")), scan, "full").fillna(0)
    return out.withColumn("share", F.col("masked_area") / viewport).withColumn("inflation", F.try_divide("masked_area", "truth_area"))


def mark_quality(truth: DataFrame, marks: DataFrame, scan: str = "scan_id") -> DataFrame:
    """scan, recall, role_accuracy, mean_iou, missed (roles of truth marks without a match)."""
    m = match_detections(truth, marks, scan)
    rows = truth.select(scan, F.col("ord").alias("a_id"), F.col("role").alias("its_role")).join(m, [scan, "a_id"], "left").join(marks.select(scan, F.col("ord").alias("b_id"), "role"), [scan, "b_id"], "left")
    hit = F.col("b_id").isNotNull()
    return rows.groupBy(scan).agg(F.avg(hit.cast("int")).alias("recall"), F.avg(F.when(hit, (F.col("role") == F.col("its_role")).cast("int"))).alias("role_accuracy"), F.avg("iou").alias("mean_iou"), F.array_sort(F.collect_list(F.when(~hit, F.col("its_role")))).alias("missed"))


def id_stability(marks: DataFrame) -> DataFrame:
    """page, repeats, n_sets, stable: whether all repeats of a page have the same ids."""
    sets = marks.groupBy("page", "repeat").agg(F.array_sort(F.collect_set("mark_id")).alias("ids"))
    out = sets.groupBy("page").agg(F.count("*").alias("repeats"), F.count_distinct("ids").alias("n_sets"), F.min(F.size("ids")).alias("least"))
    return out.select("page", "repeats", "n_sets", ((F.col("repeats") >= 2) & (F.col("n_sets") == 1) & (F.col("least") > 0)).alias("stable"))


def nearest_rank(c: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")


def page_metrics(runs: DataFrame) -> DataFrame:
    """page, mean recall, precision and IoU (nulls aside), leaks, p95 of the total time, missed types."""
    return runs.groupBy("page").agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("mean_iou").alias("mean_iou"), F.sum("leaks").alias("leaks"), nearest_rank("total_ms", 0.95).alias("p95_ms"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("missed")))).alias("missed"))


def overall_metrics(pages: DataFrame) -> DataFrame:
    """Means over pages, totals, and whether every page is clean."""
    return pages.agg(F.count("*").alias("pages"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.sum("leaks").alias("leaks"), F.bool_and(F.col("leaks") == 0).alias("clean"))


def latency_profile(timings: DataFrame, stages: list[str]) -> DataFrame:
    """fixture (null: all), cached, stage, n, p50, p95: nearest ranks by stage; cold and warm apart. All stages, each fixture and
    all fixtures together are ranked in one go, and no task holds a group's values."""
    long = timings.unpivot(["fixture", "cached"], stages, "stage", "ms")
    both = F.explode(F.array(F.struct(F.lit(False).alias("all"), F.col("fixture")), F.struct(F.lit(True).alias("all"), F.lit(None).cast(timings.schema["fixture"].dataType).alias("fixture"))))
    long = long.select(both.alias("_f"), "cached", "stage", "ms").select("_f.all", "_f.fixture", "cached", "stage", "ms")
    return nearest_ranks(long, ["all", "fixture", "cached", "stage"], "ms", {"p50": 0.5, "p95": 0.95}).drop("all")


def report(runs: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """The tables of a quality report: overall (metric, value), pages (a row each), detectors (a row for each page, and one for all).

    runs: page, regions, recall, precision, mean_iou, leaks, ink, masked, mark_recall, role_accuracy, mark_iou, total_ms, ids_stable;
    one row for each scan. sources: page, source, n, only_n (regions that this source alone reached). A page's value is the mean
    of its scans (leaks: their sum, regions: the most); overall values are means over pages, leaks and regions sums. One pass of
    grouping sets makes both levels, over measures that were unpivoted; nulls count nowhere."""
    measures = ["regions", "recall", "precision", "mean_iou", "leaks", "ink", "masked", "mark_recall", "role_accuracy", "mark_iou", "total_ms"]
    long = runs.select("page", *(F.col(m).cast("double").alias(m) for m in measures)).unpivot(["page"], measures, "metric", "value").filter("value is not null")
    each = long.groupBy("page", "metric").agg(F.avg("value").alias("mean"), F.sum("value").alias("total"), F.max("value").alias("most"))
    value = F.when(F.col("metric") == "leaks", F.col("total")).when(F.col("metric") == "regions", F.col("most")).otherwise(F.col("mean"))
    sets = each.select("page", "metric", value.alias("value")).groupingSets([["page", "metric"], ["metric"]], "page", "metric")
    sets = sets.agg(F.avg("value").alias("mean"), F.sum("value").alias("total"), F.grouping("page").alias("all"))
    levels = sets.withColumn("value", F.when(F.col("metric").isin("leaks", "regions"), F.col("total")).otherwise(F.col("mean")))
    pages = levels.filter("all = 0").groupBy("page").pivot("metric", measures).agg(F.first("value"))
    ranked = nearest_ranks(runs, ["page"], "total_ms", {"p95_ms": 0.95}).select("page", "p95_ms")
    p95 = nearest_ranks(ranked, [], "p95_ms", {"value": 0.95}).select(F.lit("p95_ms").alias("metric"), "value")
    stable = runs.agg(F.bool_and("ids_stable").cast("double").alias("value")).select(F.lit("ids_stable").alias("metric"), "value")
    overall = levels.filter("all = 1").select("metric", "value").unionByName(p95).unionByName(stable)
    by = sources.groupingSets([["page"], []], "page").agg(
        *(F.coalesce(F.sum(F.when(F.col("source") == s, F.col("n"))), F.lit(0)).alias(name) for s, name in (("dom", "dom"), ("vision_face", "face"), ("vision_ocr", "ocr"))),
        F.coalesce(F.sum(F.when(F.col("source") == "vision_ocr", F.col("only_n"))), F.lit(0)).alias("only_ocr"), F.grouping("page").cast("int").alias("all"),
    )
    return {"overall": overall, "pages": pages, "detectors": by}


def profile_compare(runs: DataFrame, profiles: list[str]) -> DataFrame:
    """page and, for each profile, recall, leaks and mean time, side by side."""
    return runs.groupBy("page").pivot("profile", profiles).agg(F.avg("recall").alias("recall"), F.sum("leaks").alias("leaks"), F.avg("total_ms").alias("ms"))


def outcome_flags(runs: DataFrame) -> DataFrame:
    """runs with false_positive (claimed, no error, but not so) and false_negative (not claimed or failed, and not so)."""
    claimed = F.coalesce("done", F.lit(False)) & F.col("error").isNull()
    wrong = ~F.coalesce("outcome_verified", F.lit(False))
    return runs.withColumn("false_positive", claimed & wrong).withColumn("false_negative", ~claimed & wrong)


def reliability(runs: DataFrame) -> DataFrame:
    """Rates over runs; recovery is 1 where no loop came up."""
    df = outcome_flags(runs)
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return df.agg(
        F.count("*").alias("n"), rate(F.col("done")).alias("completion"), rate(F.col("clean_termination")).alias("clean"), rate(F.col("false_positive")).alias("fp_rate"), rate(F.col("false_negative")).alias("fn_rate"),
        F.try_divide(F.sum("incorrect_actions"), F.sum("steps")).alias("incorrect_rate"), F.try_divide(F.sum("loop_incidents"), F.count("*")).alias("loops_a_run"),
        F.coalesce(F.try_divide(F.sum("loop_recoveries"), F.sum("loop_incidents")), F.lit(1.0)).alias("recovery"), F.avg("run_ms").alias("mean_run_ms"),
    )


def stage_depth(stages: DataFrame) -> DataFrame:
    """run, n, depth (stages before the first miss), reached (depth of 60 % at least)."""
    out = stages.groupBy("run").agg(F.count("*").alias("n"), F.min(F.when(~F.col("ok"), F.col("ord"))).alias("miss"), F.min("ord").alias("first"))
    out = out.withColumn("depth", F.coalesce(F.col("miss") - F.col("first"), F.col("n")))
    return out.select("run", "n", "depth", (F.col("depth") >= F.ceil(0.6 * F.col("n"))).alias("reached"))


def query_landed(runs: DataFrame) -> DataFrame:
    """runs (query, url, title, field, error, blocked, acted) with outcome."""
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]", "")
    q = plain("query")
    landed = (q != "") & (F.contains(plain("url"), q) | F.contains(plain("title"), q) | F.contains(plain("field"), q))
    return runs.withColumn("outcome", F.when(F.col("error").isNotNull(), "error").when(F.col("blocked"), "blocked").when(q == "", F.when(F.col("acted"), "acted").otherwise("not landed")).when(landed, "landed").otherwise("not landed"))
