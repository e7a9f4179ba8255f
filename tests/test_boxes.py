"""Folds over boxes and pixels against plain models on random tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F


from maskline.functions import groups
from maskline.operators import images, quality, regions

BOX = "scan_id int, ord int, x int, y int, w int, h int, source string, confidence double, circular boolean, score double"


def random_boxes(seed, scans=12):
    rng = random.Random(seed)
    rows = []
    for s in range(scans):
        for i in range(rng.randint(0, 25)):
            rows.append((s, i, rng.randint(0, 150), rng.randint(0, 100), rng.randint(5, 80), rng.randint(5, 60), rng.choice(["dom", "vision_face", "vision_ocr"]), rng.randint(50, 99) / 100, rng.random() < 0.15, rng.randint(1, 20) / 20))
    return rows


def shared(a, b):
    return max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))


def iou(a, b):
    s = shared(a, b)
    return s / (a[2] * a[3] + b[2] * b[3] - s)


def test_overlap_pairs(spark):
    rows = random_boxes(1)
    df = spark.createDataFrame(rows, BOX)
    got = {(r["scan_id"], r["a_id"], r["b_id"]): r["shared"] for r in regions.overlap_pairs(df, df, "scan_id", "ord", "ord", 20).collect()}
    assert got == {(a[0], a[1], b[1]): s for a in rows for b in rows if a[0] == b[0] and (s := shared(a[2:6], b[2:6]))}


def test_nms_and_dedupe(spark):
    rows = random_boxes(2)
    df = spark.createDataFrame(rows, BOX)
    want, near = set(), set()
    for s in range(12):
        kept, first = [], []
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (-r[9], r[1])):
            if all(iou(r[2:6], k[2:6]) <= 0.3 for k in kept):
                kept.append(r)
        for r in sorted(r for r in rows if r[0] == s):
            if all(abs(r[2] - k[2]) > 10 or abs(r[3] - k[3]) > 10 for k in first):
                first.append(r)
        want |= {(s, r[1]) for r in kept}
        near |= {(s, r[1]) for r in first}
    assert {(r["scan_id"], r["ord"]) for r in regions.nms(df).collect()} == want
    assert {(r["scan_id"], r["ord"]) for r in regions.dedupe_near(df, 10).collect()} == near


def merge_model(rows, containment):
    out = []
    for r in sorted(rows, key=lambda r: (regions.SOURCE_ORDER[r[6]], r[1])):
        b = {"box": list(r[2:6]), "conf": r[7], "src": [r[6]], "circ": r[8], "ord": r[1]}
        for a in out:
            p, q = a["box"], b["box"]
            near = all(abs(p[i] - q[i]) <= 6 for i in (0, 1)) and all(abs(p[i] - q[i]) <= 8 for i in (2, 3))
            cx, cy = q[0] + q[2] / 2, q[1] + q[3] / 2
            inside = p[0] - 4 <= cx <= p[0] + p[2] + 4 and p[1] - 4 <= cy <= p[1] + p[3] + 4
            hit = near or iou(p, q) >= 0.5 or a["circ"] and (iou(p, q) > 0.10 or inside)
            s = shared(p, q)
            if containment:
                hit = hit or s / (p[2] * p[3]) > 0.55 or s / (q[2] * q[3]) > 0.55
            if hit:
                if not a["circ"]:
                    x, y = min(p[0], q[0]), min(p[1], q[1])
                    a["box"] = [x, y, max(p[0] + p[2], q[0] + q[2]) - x, max(p[1] + p[3], q[1] + q[3]) - y]
                a["conf"], a["src"], a["circ"] = max(a["conf"], b["conf"]), list(dict.fromkeys(a["src"] + b["src"])), a["circ"] or b["circ"]
                break
        else:
            out.append(b)
    return out


@pytest.mark.parametrize("containment", [True, False])
def test_merge(spark, containment):
    rows = random_boxes(3)
    got = regions.merge_regions(spark.createDataFrame(rows, BOX), containment=containment).collect()
    want = [(s, a["ord"], *a["box"], a["conf"], tuple(a["src"]), a["circ"]) for s in range(12) for a in merge_model([r for r in rows if r[0] == s], containment)]
    assert sorted((r["scan_id"], r["ord"], r["x"], r["y"], r["w"], r["h"], r["confidence"], tuple(r["sources"]), r["circular"]) for r in got) == sorted(want)


def test_union_coverage_and_matches(spark):
    rows = random_boxes(4)
    truth, pred = [r for r in rows if r[1] % 3 == 0], [r for r in rows if r[1] % 3]
    t, p = spark.createDataFrame(truth, BOX), spark.createDataFrame(pred, BOX)
    got = {(r["scan_id"], r["truth_id"]): r["covered"] for r in regions.union_coverage(t.withColumn("truth_id", F.col("ord")), p).collect()}
    for r in truth:
        cells = {(x, y) for q in pred if q[0] == r[0] for x in range(max(r[2], q[2]), min(r[2] + r[4], q[2] + q[4])) for y in range(max(r[3], q[3]), min(r[3] + r[5], q[3] + q[5]))}
        assert got[r[0], r[1]] == pytest.approx(len(cells) / (r[4] * r[5]))
    want = set()
    for s in range(12):
        pairs = sorted((-shared(a[2:6], b[2:6]) / (a[4] * a[5]), -iou(a[2:6], b[2:6]), a[1], b[1]) for a in truth for b in pred if a[0] == b[0] == s and shared(a[2:6], b[2:6]) >= 0.5 * a[4] * a[5])
        used = set()
        for _, _, i, j in pairs:
            if ("a", i) not in used and ("b", j) not in used:
                used |= {("a", i), ("b", j)}
                want.add((s, i, j))
    assert {(r["scan_id"], r["a_id"], r["b_id"]) for r in quality.match_detections(t, p).collect()} == want


def test_normalize_and_classify(spark):
    df = spark.createDataFrame([("dom", 1.4, 2.6, 30.0, 40.0, None), ("vision_ocr", 0.0, 0.0, -1.0, 5.0, 0.5), ("dom", float("nan"), 0.0, 1.0, 1.0, None)], "source string, left double, top double, right double, height double, confidence double")
    (r,) = regions.normalize_regions(df).collect()
    assert (r["x"], r["y"], r["w"], r["h"], r["reason"], r["confidence"]) == (1, 3, 29, 40, "dom_rule", 0.95)
    marks = spark.createDataFrame([(1, "input:password", "input", "Password"), (2, "button", "button", "Add to cart")], "scan_id int, role string, tag string, label string")
    scans = spark.createDataFrame([(1, "x", "/", 800), (2, "y", "/", 800), (3, "z", "/", 800)], "scan_id int, title string, path string, viewport_height int")
    assert {r["scan_id"]: r["category"] for r in regions.classify_screens(marks, scans).collect()} == {1: "authentication", 2: "ecommerce_checkout", 3: "general_interaction"}


def test_components_of_patches(spark):
    grid = ["XX...", "X...X", "...X.", ".....", "XXXXX"]
    rows = [(1, x, y, 30.0 if c == "X" else 1.0, 100.0) for y, line in enumerate(grid) for x, c in enumerate(line)]
    got = regions.cluster_patches(spark.createDataFrame(rows, "image_id int, px int, py int, energy double, luminance double")).collect()
    assert [(r["n"], r["kind"]) for r in got] == [(5, "strip")]


def test_ink_survival(spark):
    px = [(1, x, y, *([0] * 3 if (x + y) % 3 == 0 else [200] * 3)) for x in range(10) for y in range(10)]
    ref = spark.createDataFrame(px, "image_id int, x int, y int, r int, g int, b int")
    black = ref.withColumns({c: F.lit(90) for c in "rgb"})
    boxes = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 1, 50, 50, 5, 5)], "image_id int, box_id int, x int, y int, w int, h int")
    assert {r["box_id"]: (r["n_ink"], r["leaked"]) for r in images.ink_survival(ref, ref, boxes).collect()} == {0: (34, True), 1: (0, False)}
    assert not images.ink_survival(ref, black, boxes).filter("leaked").count()
    assert {r["box_id"]: r["dark_share"] for r in images.region_stats(ref, boxes).collect()}[1] == 1.0


def test_probed_ids(spark):
    """Few slots, so that rows come round past the end: the ids of linear probing, one row after the other."""
    draw = random.Random(4)
    rows = [(p, i, draw.choice([0, 1, 2, 9, 9, 10, 10, 10])) for p in range(60) for i in range(draw.randint(0, 11))]
    df = spark.createDataFrame(rows, "page int, ord int, own int")
    got = {}
    for r in regions.probed(df, "page", "own", 11, ["ord"]).collect():
        got.setdefault(r["page"], set()).add(r["_slot"])
    for page, slots in got.items():
        mine, taken = [r for r in rows if r[0] == page], set()
        for _, _, own in mine:
            while own in taken:
                own = (own + 1) % 11
            taken.add(own)
        assert slots == taken and len(slots) == len(mine)


def test_string_hash(spark):
    texts = ["", "a", "input|text|Näme|1|2", "x" * 100, "\U0001f600y", None]

    def by_hand(t):
        h = 0
        for unit in (t.encode("utf-16-le")[i : i + 2] for i in range(0, 2 * (len(t.encode("utf-16-le")) // 2), 2)):
            h = (h * 31 + int.from_bytes(unit, "little")) & 0xFFFFFFFF
        return abs(h - (1 << 32) if h >= 1 << 31 else h)

    got = spark.createDataFrame([(t,) for t in texts], "t string").select(regions.string_hash(F.col("t")).alias("h")).collect()
    assert [r["h"] for r in got] == [None if t is None else by_hand(t) for t in texts]


def test_ids_stay_and_differ(spark):
    rows = [(1, i, "a", "button", "Go" if i < 3 else f"G{i}", 10, 20, 30, 40) for i in range(6)] + [(2, 0, "a", "button", "Go", 11, 20, 30, 40)]
    df = spark.createDataFrame(rows, "page_id int, ord int, tag string, role string, label string, x int, y int, w int, h int")
    got = regions.stable_ids(df).collect()
    ids = {(r["page_id"], r["ord"]): r["stable_id"] for r in got}
    assert len({v for k, v in ids.items() if k[0] == 1}) == 6 and ids[1, 0] == ids[2, 0] and ids[1, 1] == ids[1, 0] + 1
    assert all(1000 <= v < 1000 + regions.ID_SLOTS for v in ids.values())


def test_scans_side_by_side():
    """Scans of one box to 300: side by side they give what each gives alone, and only like sizes are padded to each other."""
    r = np.random.default_rng(5)
    sizes = np.concatenate([r.integers(1, 40, 200), [1] * 500, [256, 300, 3]])
    at = np.concatenate([[0], np.cumsum(sizes)])
    b = {c: r.integers(0, 150, at[-1]).astype(float) for c in "xywh"} | {"confidence": np.where(r.random(at[-1]) < 0.2, np.nan, r.random(at[-1])), "circular": (r.random(at[-1]) < 0.1).astype(float)}
    small, large = groups.side_by_side(at)
    assert [at[g + 1] - at[g] for g in large] == [300] and sum(len(f) for f, _ in small) == len(sizes) - 1
    assert sum(len(f) * s.max() for f, s in small) <= 4 * at[-1]
    for first, size in small:
        a, n, place = regions._merged_of_many(b, first, size, 0.5, True)
        for k, (f, s) in enumerate(zip(first.tolist(), size.tolist())):
            one, members = regions._merged({c: v[f : f + s] for c, v in b.items()}, 0.5, True)
            assert n[k] == len(members)
            for c in one:
                np.testing.assert_array_equal(a[c][k, : n[k]], one[c])
            assert all(place[f + i] == j for j, m in enumerate(members) for i in m)


def test_patches_of_many_images_are_labelled_as_by_a_flood(spark):
    rng, rows, want = random.Random(8), [], set()
    for image in range(40):
        cells = {(rng.randint(0, 11), rng.randint(-3, 8)) for _ in range(rng.randint(0, 70))}
        rows += [(image, x, y, 30.0, 100.0) for x, y in cells]
        while cells:
            part, todo = set(), [min(cells, key=lambda c: (c[1], c[0]))]
            first = todo[0]
            while todo:
                x, y = todo.pop()
                if (x, y) in cells:
                    cells.discard((x, y)), part.add((x, y))
                    todo += [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            if 4 <= len(part) <= 150:
                want.add((image, first[1], first[0], len(part), min(x for x, _ in part), min(y for _, y in part), max(x for x, _ in part), max(y for _, y in part)))
    got = regions.cluster_patches(spark.createDataFrame(rows, "image_id int, px int, py int, energy double, luminance double"))
    assert {tuple(r)[:8] for r in got.collect()} == want
    assert regions.cluster_patches(spark.createDataFrame(rows, "image_id int, px int, py int, energy double, luminance double").limit(0)).collect() == []


def test_pixels_are_shuffled_once(spark):
    px = spark.createDataFrame([(1, x, y, x, y, 9) for x in range(4) for y in range(4)], "image_id int, x int, y int, r int, g int, b int")
    stats = images.patch_stats(px, 2)
    assert stats._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r["px"], r["py"], r["mean_r"], r["energy"]) for r in stats.collect()} == {(i, j, 2 * i + 0.5, 1.0) for i in (0, 1) for j in (0, 1)}


def test_cells_change_no_match(spark):
    df = spark.createDataFrame(random_boxes(5), BOX)
    t, p = df.filter("ord % 3 = 0"), df.filter("ord % 3 <> 0")
    got = [sorted(map(tuple, quality.detection_quality(t, p.filter("ord % 3 = 1"), p.filter("ord % 3 = 2"), cell=c).collect()), key=repr) for c in (16, 64, 256)]
    assert got[0] and got[0] == got[1] == got[2]
