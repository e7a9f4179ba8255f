"""Tables of bounding boxes: normalize, merge, filter, cluster and classify the boxes that detectors report."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskline.functions import scalars as S
from maskline.functions.groups import kept_rows, lots, numbers, side_by_side
from maskline.plans.session import ship

#: Order in which the sources of a scan are merged, and the reason that a region has by default.
SOURCE_ORDER = {"dom": 0, "vision_face": 1, "vision_ocr": 2}
REASONS = {"dom": "dom_rule", "vision_face": "face_detected", "vision_ocr": "ocr_text_match"}


def box(prefix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in ("x", "y", "w", "h")))


def normalize_regions(df: DataFrame) -> DataFrame:
    """Regions with x, y, w, h from whatever columns are there (left/top, width/height, right/bottom); rounded.

    Boxes that aren't finite or have no area go. Missing type, reason and confidence get their source's defaults.
    """
    have = set(df.columns)

    def first(*names: str) -> Column:
        found = [F.col(n).cast("double") for n in names if n in have]
        return F.coalesce(*found, F.lit(None).cast("double"))

    x, y = first("x", "left"), first("y", "top")
    w, h = F.coalesce(first("w", "width"), first("right") - x), F.coalesce(first("h", "height"), first("bottom") - y)
    source = F.col("source")
    reason = F.lit("unknown")
    for k, v in REASONS.items():
        reason = F.when(source == k, v).otherwise(reason)
    old = {c: (F.col(c) if c in have else F.lit(None).cast("string")) for c in ("type", "reason")}
    confidence = F.col("confidence").cast("double") if "confidence" in have else F.lit(None).cast("double")
    keep = [c for c in df.columns if c not in {"x", "y", "w", "h", "left", "top", "width", "height", "right", "bottom", "type", "reason", "confidence"}]
    out = df.select(*keep, x.alias("_x"), y.alias("_y"), w.alias("_w"), h.alias("_h"), F.coalesce(old["type"], F.lit("sensitive")).alias("type"), F.coalesce(old["reason"], reason).alias("reason"), F.coalesce(confidence, F.when(source == "dom", 0.95).otherwise(0.85)).alias("confidence"))
    big = float(1 << 31)
    out = out.filter(F.greatest(F.abs("_x"), F.abs("_y"), F.abs("_w"), F.abs("_h")) < big)
    out = out.select(*keep, *(F.round(f"_{c}").cast("int").alias(c) for c in ("x", "y", "w", "h")), "type", "reason", "confidence")
    return out.filter("w > 0 and h > 0")


def to_viewport(regions: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions shifted by their frame's offset, counts by scan): frames without an offset are left out and counted."""
    moved = regions.join(frames.select("scan_id", "frame_id", "offset"), ["scan_id", "frame_id"]).filter("offset is not null")
    moved = moved.withColumns({"x": F.col("x") + F.col("offset.x"), "y": F.col("y") + F.col("offset.y")}).drop("offset")
    counts = frames.groupBy("scan_id").agg(F.count("*").alias("total"), F.count_if(F.col("offset").isNotNull()).alias("merged"), F.count_if(F.col("offset").isNull()).alias("skipped"))
    return moved, counts


def first_marks(marks: DataFrame) -> DataFrame:
    """Of marks with the same id in a scan the one of the first frame."""
    first = F.row_number().over(Window.partitionBy("scan_id", "mark_id").orderBy("frame_id"))
    return marks.withColumn("_n", first).filter("_n = 1").drop("_n")


def clip(df: DataFrame, width: int, height: int, least: int = 4) -> DataFrame:
    """Boxes cut to the viewport; those of less than `least` pixels either way go."""
    x, y = F.greatest("x", F.lit(0)), F.greatest("y", F.lit(0))
    w, h = F.least(F.col("x") + F.col("w"), F.lit(width)) - x, F.least(F.col("y") + F.col("h"), F.lit(height)) - y
    return df.withColumns({"x": x, "y": y, "w": w, "h": h}).filter((F.col("w") >= least) & (F.col("h") >= least))


def overlap_pairs(a: DataFrame, b: DataFrame, scan: str, a_id: str, b_id: str, cell: int = 64) -> DataFrame:
    """scan, a_id, b_id, shared, iou, covered (share of a) of boxes that overlap.

    Boxes meet only in the grid cells that both touch, so a scan of many boxes isn't expanded into all pairs. cell, in pixels, changes
    the work alone: a box is sent once for each cell that it touches, so cells should be larger than most boxes.
    """

    def cells(df: DataFrame, key: str, name: str) -> DataFrame:
        xs = F.sequence(F.floor(F.col("x") / cell), F.floor((F.col("x") + F.col("w") - 1) / cell))
        ys = F.sequence(F.floor(F.col("y") / cell), F.floor((F.col("y") + F.col("h") - 1) / cell))
        rows = df.filter("w > 0 and h > 0").select(F.col(scan).alias("_scan"), F.col(key).alias(f"{name}_id"), box().alias(name), F.explode(xs).alias("_cx"), ys.alias("_ys"))
        return rows.select("_scan", f"{name}_id", name, "_cx", F.explode("_ys").alias("_cy"))

    left, right = cells(a, a_id, "a"), cells(b, b_id, "b")
    # of all cells that two boxes share, the one with the upper left corner of their overlap counts
    first = (F.col("_cx") == F.floor(F.greatest("a.x", "b.x") / cell)) & (F.col("_cy") == F.floor(F.greatest("a.y", "b.y") / cell))
    shared = S.overlap_area(F.col("a"), F.col("b"))
    rows = left.join(right, ["_scan", "_cx", "_cy"]).filter(first & (shared > 0))
    return rows.select(F.col("_scan").alias(scan), "a_id", "b_id", shared.cast("long").alias("shared"), S.iou(F.col("a"), F.col("b")).alias("iou"), S.coverage(F.col("a"), F.col("b")).alias("covered"))


def _overlaps(a: dict[str, np.ndarray], n: int, b: dict[str, np.ndarray], i: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared area and IoU of the first n boxes of a with the i-th of b."""
    w = np.minimum(a["x"][:n] + a["w"][:n], b["x"][i] + b["w"][i]) - np.maximum(a["x"][:n], b["x"][i])
    h = np.minimum(a["y"][:n] + a["h"][:n], b["y"][i] + b["h"][i]) - np.maximum(a["y"][:n], b["y"][i])
    shared = np.maximum(w, 0) * np.maximum(h, 0)
    union = a["w"][:n] * a["h"][:n] + b["w"][i] * b["h"][i] - shared
    return shared, np.where(union > 0, shared / np.where(union > 0, union, 1), 0.0)


def _merged(b: dict[str, np.ndarray], least_iou: float, containment: bool) -> tuple[dict[str, np.ndarray], list[list]]:
    """The regions of one scan, and the places of the boxes that each holds."""
    a, members, n = {k: v.copy() for k, v in b.items()}, [], 0
    for i in range(len(b["x"])):
        shared, iou = _overlaps(a, n, b, i)
        near = (np.abs(a["x"][:n] - b["x"][i]) <= 6) & (np.abs(a["y"][:n] - b["y"][i]) <= 6) & (np.abs(a["w"][:n] - b["w"][i]) <= 8) & (np.abs(a["h"][:n] - b["h"][i]) <= 8)
        cx, cy = b["x"][i] + b["w"][i] / 2, b["y"][i] + b["h"][i] / 2
        inside = (cx >= a["x"][:n] - 4) & (cx <= a["x"][:n] + a["w"][:n] + 4) & (cy >= a["y"][:n] - 4) & (cy <= a["y"][:n] + a["h"][:n] + 4)
        match = near | (iou >= least_iou) | ((a["circular"][:n] > 0) & ((iou > 0.10) | inside))
        if containment:
            area, own = a["w"][:n] * a["h"][:n], b["w"][i] * b["h"][i]
            match |= (area > 0) & (shared > 0.55 * area) | ((shared > 0.55 * own) if own > 0 else False)
        if not match.any():
            for k in a:
                a[k][n] = b[k][i]
            members.append([i])
            n += 1
            continue
        k = int(match.argmax())
        if not a["circular"][k] > 0:
            x, y = min(a["x"][k], b["x"][i]), min(a["y"][k], b["y"][i])
            w, h = max(a["x"][k] + a["w"][k], b["x"][i] + b["w"][i]) - x, max(a["y"][k] + a["h"][k], b["y"][i] + b["h"][i]) - y
            a["x"][k], a["y"][k], a["w"][k], a["h"][k] = x, y, w, h
        a["confidence"][k] = np.fmax(a["confidence"][k], b["confidence"][i])
        a["circular"][k] = max(a["circular"][k], b["circular"][i])
        members[k].append(i)
    return {k: v[:n] for k, v in a.items()}, members


def _overlaps_of_many(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shared area and IoU of each row of boxes of a with the row's box of b."""
    w = np.minimum(a["x"] + a["w"], b["x"] + b["w"]) - np.maximum(a["x"], b["x"])
    h = np.minimum(a["y"] + a["h"], b["y"] + b["h"]) - np.maximum(a["y"], b["y"])
    shared = np.maximum(w, 0) * np.maximum(h, 0)
    union = a["w"] * a["h"] + b["w"] * b["h"] - shared
    return shared, np.where(union > 0, shared / np.where(union > 0, union, 1), 0.0)


def _merged_of_many(b: dict[str, np.ndarray], first: np.ndarray, sizes: np.ndarray, least_iou: float, containment: bool) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """_merged() of many scans at once: the i-th boxes of all scans are looked at together. (regions as scans by places, how many each scan has,
    each box's place among its scan's regions). Scans stand by their sizes, so that those with an i-th box are the last ones."""
    longest = int(sizes.max(initial=0))
    a, n = {k: np.zeros((len(first), longest)) for k in b}, np.zeros(len(first), np.int64)
    place = np.full(len(b["x"]), -1)
    for i in range(longest):
        low = int(np.searchsorted(sizes, i, "right"))
        rows, most = first[low:] + i, int(n[low:].max(initial=0))
        o, c = {k: v[low:, :most] for k, v in a.items()}, {k: v[rows][:, None] for k, v in b.items()}
        shared, iou = _overlaps_of_many(o, c)
        match = (np.abs(o["x"] - c["x"]) <= 6) & (np.abs(o["y"] - c["y"]) <= 6) & (np.abs(o["w"] - c["w"]) <= 8) & (np.abs(o["h"] - c["h"]) <= 8) | (iou >= least_iou)
        cx, cy = c["x"] + c["w"] / 2, c["y"] + c["h"] / 2
        inside = (cx >= o["x"] - 4) & (cx <= o["x"] + o["w"] + 4) & (cy >= o["y"] - 4) & (cy <= o["y"] + o["h"] + 4)
        match |= (o["circular"] > 0) & ((iou > 0.10) | inside)
        if containment:
            area, own = o["w"] * o["h"], c["w"] * c["h"]
            match |= (area > 0) & (shared > 0.55 * area) | (own > 0) & (shared > 0.55 * own)
        match &= np.arange(most) < n[low:, None]
        joins = match.any(axis=1) if most else np.zeros(len(rows), bool)
        fresh = np.flatnonzero(~joins)
        for k, v in a.items():
            v[low + fresh, n[low + fresh]] = b[k][rows[fresh]]
        place[rows[fresh]] = n[low + fresh]
        n[low + fresh] += 1
        old = np.flatnonzero(joins)
        if not len(old):
            continue
        at, r = match[old].argmax(axis=1), rows[old]
        place[r] = at
        mine = {k: v[low + old, at] for k, v in a.items()}
        grows = ~(mine["circular"] > 0)
        x, y = np.minimum(mine["x"], b["x"][r]), np.minimum(mine["y"], b["y"][r])
        wide = {"x": x, "y": y, "w": np.maximum(mine["x"] + mine["w"], b["x"][r] + b["w"][r]) - x, "h": np.maximum(mine["y"] + mine["h"], b["y"][r] + b["h"][r]) - y}
        for k, v in wide.items():
            a[k][low + old, at] = np.where(grows, v, mine[k])
        a["confidence"][low + old, at] = np.fmax(mine["confidence"], b["confidence"][r])
        a["circular"][low + old, at] = np.maximum(mine["circular"], b["circular"][r])
    return a, n, place


def merge_regions(df: DataFrame, scan: str = "scan_id", least_iou: float = 0.5, containment: bool = True) -> DataFrame:
    """Greedy union of a scan's regions, in the order of source and ord: each joins the first region that it matches.

    A match: nearly the same box, IoU from least_iou, over 0.55 of either box inside the other (option), or a circular
    region that overlaps. A circular region keeps its own box. df: scan, ord, x, y, w, h, source, confidence, circular.
    Returns scan, x, y, w, h, confidence (the highest), sources, circular, ord (the first). Boxes with a null side are left
    out; null circular: false. A scan is one screen: its boxes are folded by one task, each against
    all regions at once; small scans side by side.
    """
    rank = F.lit(9)
    for k, v in SOURCE_ORDER.items():
        rank = F.when(F.col("source") == k, v).otherwise(rank)
    sides = [F.col(c).cast("int").alias(c) for c in ("x", "y", "w", "h")]
    rows = df.select(scan, *sides, F.col("confidence").cast("double").alias("confidence"), "source", F.coalesce("circular", F.lit(False)).alias("circular"), F.col("ord").cast("int").alias("ord"), rank.alias("_rank")).dropna(subset=["x", "y", "w", "h"])
    kind = rows.schema[scan].dataType.simpleString()
    names = [scan, "x", "y", "w", "h", "confidence", "sources", "circular", "ord"]
    ship(df.sparkSession)

    def table(t: pa.Table, a: dict[str, np.ndarray], of: np.ndarray, rows: np.ndarray) -> pa.Table:
        """Regions a, of which the boxes at `rows` are parts: `of` tells which."""
        first, sources = np.full(len(a["x"]), -1), [{} for _ in a["x"]]
        first[of[::-1]] = rows[::-1]
        for k, x in zip(of.tolist(), t["source"].take(pa.array(rows)).to_pylist()):
            sources[k].setdefault(x)
        at = pa.array(first, pa.int64())
        values = [t[scan].combine_chunks().take(at), *(pa.array(a[c].astype(int), pa.int32()) for c in ("x", "y", "w", "h")), pa.array(a["confidence"], pa.float64(), mask=np.isnan(a["confidence"]))]
        values += [pa.array([list(x) for x in sources], pa.list_(pa.string())), pa.array(a["circular"] > 0), t["ord"].combine_chunks().take(at)]
        return pa.Table.from_arrays(values, names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in lots(batches, scan):
            boxes = {c: numbers(t, c) for c in ("x", "y", "w", "h", "confidence", "circular")}
            small, large = side_by_side(at)
            for first, sizes in small:
                a, n, place = _merged_of_many(boxes, first, sizes, least_iou, containment)
                taken = np.arange(a["x"].shape[1]) < n[:, None]
                rows = np.repeat(first, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                of = np.repeat(np.cumsum(n) - n, sizes) + place[rows]  # after the regions of the scans before
                yield from table(t, {k: v[taken] for k, v in a.items()}, of, rows).combine_chunks().to_batches(4096)
            for g in large:
                a, members = _merged({c: v[at[g] : at[g + 1]] for c, v in boxes.items()}, least_iou, containment)
                of = np.empty(at[g + 1] - at[g], np.int64)
                for k, m in enumerate(members):
                    of[m] = k
                yield from table(t, a, of, np.arange(at[g], at[g + 1])).combine_chunks().to_batches(4096)

    dealt = rows.repartition(scan).sortWithinPartitions(scan, "_rank", "ord", "x", "y", "w", "h")
    return dealt.mapInArrow(each, f"`{scan}` {kind}, x int, y int, w int, h int, confidence double, sources array<string>, circular boolean, ord int")


def dedupe_near(df: DataFrame, px: int, scan: str = "scan_id") -> DataFrame:
    """Regions less those whose corner lies within px of an earlier kept one (by ord). df: scan, ord, x, y, w, h. Null corners are near none."""

    def choose(b: dict[str, np.ndarray]) -> list[int]:
        kept, grid, cell = [], {}, px + 1
        for i, (x, y) in enumerate(zip(b["x"].tolist(), b["y"].tolist())):
            if x != x or y != y:
                kept.append(i)
                continue
            cx, cy = x // cell, y // cell
            around = (p for dx in (-1, 0, 1) for dy in (-1, 0, 1) for p in grid.get((cx + dx, cy + dy), ()))
            if not any(abs(px_ - x) <= px and abs(py_ - y) <= px for px_, py_ in around):
                kept.append(i)
                grid.setdefault((cx, cy), []).append((x, y))
        return kept

    rows = df.select(scan, "ord", "x", "y", "w", "h")
    return kept_rows(rows, scan, [F.col(c) for c in ("ord", "x", "y", "w", "h")], choose, ["x", "y"])


def nms(df: DataFrame, most_iou: float = 0.3, scan: str = "scan_id") -> DataFrame:
    """Non-maximum suppression: by falling score (nulls last; ties: ord), a box goes if its IoU with a kept one is above most_iou."""

    def choose(b: dict[str, np.ndarray]) -> list[int]:
        a, kept = {k: v.copy() for k, v in b.items()}, []
        for i in range(len(b["x"])):
            if not (_overlaps(a, len(kept), b, i)[1] > most_iou).any():
                for k in a:
                    a[k][len(kept)] = b[k][i]
                kept.append(i)
        return kept

    def together(b: dict[str, np.ndarray], first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        longest = int(sizes.max(initial=0))
        a, n, out = {k: np.zeros((len(first), longest)) for k in b}, np.zeros(len(first), np.int64), [np.zeros(0, np.int64)]
        for i in range(longest):
            low = int(np.searchsorted(sizes, i, "right"))
            rows, most = first[low:] + i, int(n[low:].max(initial=0))
            iou = _overlaps_of_many({k: v[low:, :most] for k, v in a.items()}, {k: v[rows][:, None] for k, v in b.items()})[1]
            free = np.flatnonzero(~((iou > most_iou) & (np.arange(most) < n[low:, None])).any(axis=1))
            for k, v in a.items():
                v[low + free, n[low + free]] = b[k][rows[free]]
            n[low + free] += 1
            out.append(rows[free])
        return np.concatenate(out)

    rows = df.select(scan, "ord", "x", "y", "w", "h", "score")
    return kept_rows(rows, scan, [F.col("score").desc_nulls_last(), *(F.col(c) for c in ("ord", "x", "y", "w", "h"))], choose, ["x", "y", "w", "h"], together)


def filter_candidates(df: DataFrame, high_recall: bool = False) -> DataFrame:
    """Face candidates by score and shape, widened: 15 % at the sides, 25 % above, 18 % below; 12 pixels at least."""
    ratio = F.col("w") / F.col("h")
    kept = df.filter((F.col("score") >= (0.38 if high_recall else 0.65)) & ratio.between(0.35, 2.2))
    wide = {"x": F.round(F.col("x") - 0.15 * F.col("w")), "y": F.round(F.col("y") - 0.25 * F.col("h")), "w": F.round(1.30 * F.col("w")), "h": F.round(1.43 * F.col("h"))}
    return kept.withColumns({k: v.cast("int") for k, v in wide.items()}).filter("w >= 12 and h >= 12")


def filter_media(df: DataFrame, model_ran: str = "model_ran") -> DataFrame:
    """Blanket media regions go once a model has answered, but for persons (by hint) and shapes like an avatar."""
    person = F.lower(F.coalesce("hint", F.lit(""))).rlike("person|people|avatar|profile|face|portrait|user")
    ratio = F.col("w") / F.col("h")
    avatar = F.coalesce("circular", F.lit(False)) & F.col("w").between(18, 140) & F.col("h").between(18, 140) & ratio.between(0.65, 1.5)
    return df.filter(~F.coalesce(F.col(model_ran), F.lit(False)) | (F.col("type") != "media") | person | avatar)


def dilate(df: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes padded by class and cut to the image: sensitive ids 8 % / 12 %, within 6-14 and 3-6 pixels, others 5 % / 8 %, within 3-8 and 2-4."""
    strict = F.coalesce(F.col("sensitive"), F.lit(False))

    def pad(size: str, a: float, b: float, low: tuple[int, int], high: tuple[int, int]) -> Column:
        within = lambda share, r: F.least(F.greatest(F.round(F.col(size) * share), F.lit(r[0])), F.lit(r[1]))
        return F.when(strict, within(a, low)).otherwise(within(b, high)).cast("int")

    px, py = pad("w", 0.08, 0.05, (6, 14), (3, 8)), pad("h", 0.12, 0.08, (3, 6), (2, 4))
    df = df.withColumns({"_px": px, "_py": py}).withColumns({"x": F.col("x") - F.col("_px"), "y": F.col("y") - F.col("_py"), "w": F.col("w") + 2 * F.col("_px"), "h": F.col("h") + 2 * F.col("_py")}).drop("_px", "_py")
    return clip(df, width, height, 1)


#: Ordered rules (fixed values): name, confidence, condition over x, y, w, h, ar, area, energy, dispersion and the flags, reason.
#: Whoever knows a region's class says so by a flag of its own, is_<class>, which stands before the rule's condition.
CLASSES = [
    ("signature", 0.91, "dispersion > 0.6 and ar between 1.5 and 4.5 and area < 40000", "high_dispersion_stroke_contour"),
    ("qr_code", 0.95, "ar between 0.9 and 1.1 and w between 60 and 260 and energy > 45", "bicolor_matrix_density"),
    ("canvas_chart", 0.89, "is_canvas and area > 25000 or w >= 280 and h >= 140 and energy > 20", "multivariate_graph_canvas"),
    ("modal", 0.93, "w >= 360 and h >= 220 and ar between 1.1 and 2.2 and area > 100000", "elevated_container_hierarchy"),
    ("avatar", 0.92, "ar between 0.8 and 1.25 and w between 36 and 200 and energy > 16", "biometric_portrait_geometry"),
    ("radio", 0.93, "circular and w between 10 and 32", "concentric_circular_glyph"),
    ("checkbox", 0.94, "not circular and not is_radio and ar between 0.85 and 1.15 and w between 12 and 28 and h between 12 and 28", "orthogonal_glyph_box"),
    ("dropdown", 0.88, "arrow and ar between 2.2 and 8.0 and h between 22 and 55", "chevron_delimited_field"),
    ("button", 0.90, "ar between 1.4 and 5.5 and h between 24 and 60 and w <= 260", "rounded_action_rectangle"),
    ("input", 0.87, "ar between 2.8 and 12.0 and h between 24 and 55", "horizontal_entry_strip"),
    ("link", 0.81, "ar >= 1.2 and h between 12 and 24", "inline_textual_anchor"),
]
INTERACTIVE = ("radio", "checkbox", "dropdown", "button", "input", "link")


def classify_regions(df: DataFrame, least: float = 0.65, viewport: tuple[int, int] | None = None) -> DataFrame:
    """df (x, y, w, h, energy, dispersion, circular, arrow, is_canvas, and is_<class> where it is known) with class, confidence, reason,
    interactive and, for a viewport, box: the sides as shares of it, to four places. Null or absent flags are false, sides of 0 or null count as 1; unclassified rows go."""
    flags = ["circular", "arrow", "is_canvas", *(f"is_{name}" for name, *_ in CLASSES)]
    plain = df.withColumns({f: F.coalesce(F.col(f), F.lit(False)) if f in df.columns else F.lit(False) for f in flags})
    side = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(1))
    df = plain.withColumns({"_w0": F.col("w"), "_h0": F.col("h")}).withColumns({"w": side("w"), "h": side("h")}).withColumns({"ar": F.col("w") / F.col("h"), "area": F.col("w") * F.col("h")})
    rule = F
    for name, confidence, condition, reason in CLASSES:
        rule = rule.when(F.expr(f"is_{name} or ({condition})"), F.named_struct(F.lit("class"), F.lit(name), F.lit("confidence"), F.lit(confidence), F.lit("reason"), F.lit(reason)))
    kept = [c for c in df.columns if c not in ("ar", "area", "w", "h", "_w0", "_h0", "class", "confidence", "reason", *(f for f in flags if f not in ("circular", "arrow", "is_canvas")))]
    out = df.withColumn("_r", rule).filter(F.col("_r.confidence") >= least).select(*kept, F.col("_w0").alias("w"), F.col("_h0").alias("h"), "_r.class", "_r.confidence", "_r.reason")
    if viewport:
        share = lambda c, size: F.round(F.col(c) / size, 4)
        out = out.withColumn("box", F.struct(*(share(c, viewport[i % 2]).alias(c) for i, c in enumerate(("x", "y", "w", "h")))))
    return out.withColumn("interactive", F.col("class").isin(*INTERACTIVE))


def components(group: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each cell the first one (in the given order: by group, y, x) of those that it hangs together with over its 8 neighbours."""
    wide = int(x.max(initial=0) - x.min(initial=0)) + 3
    tall = int(y.max(initial=0) - y.min(initial=0)) + 3
    key = (group * tall + y - y.min(initial=0)) * wide + x - x.min(initial=0)
    same = np.flatnonzero(key[1:] == key[:-1])  # a cell that comes twice
    a, b = [same], [same + 1]
    for shift in (1, wide - 1, wide, wide + 1):
        at = np.searchsorted(key, key + shift)
        there = np.flatnonzero(key[np.minimum(at, len(key) - 1)] == key + shift)
        a.append(there), b.append(at[there])
    a, b, label = np.concatenate(a), np.concatenate(b), np.arange(len(key))
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != (up := label[label])).any():
            label = up
    return label


def cluster_patches(patches: DataFrame, image: str = "image_id", size: int = 16) -> DataFrame:
    """Connected components of busy patches (8 neighbours) of 4 to 150: image, first_y, first_x, n, x0, y0, x1, y1 (in patches), kind.

    patches: image, px, py, energy (above 18), luminance (between 20 and 235, those not included), each `size` pixels wide and tall.
    avatar: about square, 32 to 220 pixels wide; strip: over 2.5 times as wide as tall, at most 60 pixels tall; else media. One shuffle of
    the busy patches: an image is one screen, its patches are labelled by one task, those of many images at once."""
    ship(patches.sparkSession)
    busy = patches.filter("energy > 18 and luminance > 20 and luminance < 235").select(image, "px", "py").dropna()
    names = [image, "first_y", "first_x", "n", "x0", "y0", "x1", "y1"]
    kinds = {f.name: f.dataType.simpleString() for f in busy.schema}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in lots(batches, image):
            x, y = (t[c].cast(pa.int64()).to_numpy() for c in ("px", "py"))
            label, of = np.unique(components(np.repeat(np.arange(len(at) - 1), np.diff(at)), x, y), return_inverse=True)
            order = np.argsort(of, kind="stable")
            begins = np.searchsorted(of[order], np.arange(len(label)))
            ends = [op.reduceat(v[order], begins) for op, v in ((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y))]
            values = [y[label], x[label], np.diff(np.append(begins, len(of))), *ends]
            types = [t["py"].type, t["px"].type, pa.int64(), *(t[c].type for c in ("px", "py", "px", "py"))]
            columns = [t[image].combine_chunks().take(pa.array(label)), *(pa.array(v, pa.int64()).cast(kind) for v, kind in zip(values, types))]
            yield from pa.Table.from_arrays(columns, names).to_batches(4096)

    rows = busy.repartition(image).sortWithinPartitions(image, "py", "px")
    out = rows.mapInArrow(each, f"`{image}` {kinds[image]}, first_y {kinds['py']}, first_x {kinds['px']}, n long, x0 {kinds['px']}, y0 {kinds['py']}, x1 {kinds['px']}, y1 {kinds['py']}")
    w, h = (F.col("x1") - F.col("x0") + 1) * size, (F.col("y1") - F.col("y0") + 1) * size
    kind = F.when((w / h).between(0.75, 1.35) & w.between(32, 220), "avatar").when((w / h > 2.5) & (h <= 60), "strip").otherwise("media")
    return out.filter("n between 4 and 150").select(*names, kind.alias("kind"))


def classify_screens(marks: DataFrame, scans: DataFrame) -> DataFrame:
    """scan_id, category, confidence, strategy, complexity from the marks (role, tag, label) and the scan (title, path, height)."""
    role, tag, label = (F.lower(F.coalesce(c, F.lit(""))) for c in ("role", "tag", "label"))
    is_input = role.startswith("input:") | role.isin("textarea", "editable", "combobox") | tag.isin("input", "textarea")
    is_button = ~is_input & (role.isin("button", "input:submit", "input:button") | (tag == "button"))
    is_link = ~is_input & ~is_button & ((role == "link") | (tag == "a"))
    is_table = ~is_input & ~is_button & ~is_link & ((role == "table") | (tag == "table"))
    counts = marks.groupBy("scan_id").agg(
        F.count("*").alias("n_marks"), F.count_if(is_input).alias("inputs"), F.count_if(is_button).alias("buttons"), F.count_if(is_link).alias("links"), F.count_if(is_table).alias("tables"),
        F.count_if(is_input & ((role == "input:password") | label.contains("password"))).alias("passwords"),
        F.count_if(is_input & ((role == "input:search") | label.rlike("search|find|query")) | is_button & label.rlike("search|find")).alias("searches"),
        F.count_if(is_button & label.rlike("cart|buy|checkout|pay")).alias("carts"),
    )
    df = scans.join(counts, "scan_id", "left").fillna(0)
    title, path = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("path", F.lit("")))
    rules = [
        ((F.col("passwords") > 0) | title.rlike("login|sign in") | path.contains("login"), "authentication", 0.95, "vault_credentials_only"),
        ((F.col("carts") > 0) | title.rlike("cart|checkout") | path.contains("checkout"), "ecommerce_checkout", 0.92, "confirm_sensitive_actions"),
        ((F.col("inputs") >= 3) | title.rlike("signup|register|form"), "form_submission", 0.94, "vault_autofill_pipeline"),
        ((F.col("searches") > 0) & (F.col("n_marks") > 8), "search_directory", 0.88, "fast_on_device_search"),
        ((F.col("tables") > 0) | (F.col("n_marks") > 25), "dashboard_data", 0.82, "som_visual_grounding"),
        ((F.col("inputs") == 0) & (F.col("links") > 5), "document_view", 0.80, "content_scroll_navigation"),
    ]
    out = F
    for condition, *values in rules:
        out = out.when(condition, F.struct(*(F.lit(v).alias(k) for k, v in zip(("category", "confidence", "strategy"), values))))
    out = out.otherwise(F.struct(F.lit("general_interaction").alias("category"), F.lit(0.70).alias("confidence"), F.lit("hybrid_vlm").alias("strategy")))
    density = F.col("n_marks") / F.greatest(F.lit(1.0), F.coalesce("viewport_height", F.lit(800)) / 100)
    return df.withColumn("r", out).select("scan_id", "r.*", F.when(density > 4, "high").when(density > 1.5, "medium").otherwise("low").alias("complexity"), "n_marks", "inputs", "passwords", "buttons")


#: Ids of elements: how many there are, and the first (fixed values).
ID_SLOTS, FIRST_ID = 8_999_999, 1000
SEED = ["frame", "tag", "role", "input_type", "name", "dom_id", "placeholder", "label", "href", "path"]


def string_hash(c: Column) -> Column:
    """The absolute value of the signed 32-bit polynomial hash (base 31) over a text's UTF-16 units."""
    mask = (1 << 32) - 1

    def step(h: Column, ch: Column) -> Column:
        code = F.ascii(ch).cast("long")
        high, low = F.shiftright(code - 0x10000, 10) + 0xD800, (code - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00
        add = lambda x, unit: (x * 31 + unit).bitwiseAND(F.lit(mask))
        return F.when(code < 0x10000, add(h, code)).otherwise(add(add(h, high), low))

    h = F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0).cast("long"), step)
    return F.abs(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h))


def probed(df: DataFrame, page: str, own: str, slots: int, order: list[str]) -> DataFrame:
    """df with _slot: each row's own slot or the next free one, around the end; on a page no two have the same.

    Rows take their slots by own slot, then in order: the i-th gets i + the maximum of own - place over those up to it.
    What passes the end comes round once more, before all others; with no more rows than slots that settles it. A page of more
    rows than slots can't have different ids: its last rows go on past the end."""
    rows, last = Window.partitionBy(page), Window.unboundedPreceding
    for k in range(2):
        df = df.withColumn("_own", F.col(own) if k == 0 else F.when(F.col("_slot") >= slots, F.col("_slot") - slots).otherwise(F.col(own)))
        first = rows.orderBy(*(["_own"] if k == 0 else [(F.col("_slot") < slots).cast("int"), "_own"]), *order)
        df = df.withColumn("_i", F.row_number().over(first) - 1).withColumn("_slot", F.col("_i") + F.max(F.col("_own") - F.col("_i")).over(first.rowsBetween(last, 0)))
    return df.drop("_own", "_i")


def stable_ids(elements: DataFrame, page: str = "page_id", slots: int = ID_SLOTS, seed: list[str] = SEED) -> DataFrame:
    """elements with stable_id: from what identifies them and their place in steps of 4 pixels; the same at every scan, no two on a page
    the same. Columns of the seed that aren't there are left out, nulls are empty; ties go by ord."""
    place = [F.floor(F.coalesce(F.col(c), F.lit(0)) / 4 + 0.5).cast("string") for c in ("x", "y", "w", "h")]
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in seed if c in elements.columns), *place)
    df = elements.withColumn("_hash", string_hash(text) % slots)
    return probed(df, page, "_hash", slots, ["ord"]).withColumn("stable_id", F.col("_slot") + FIRST_ID).drop("_hash", "_slot")


def union_coverage(truth: DataFrame, boxes: DataFrame, scan: str = "scan_id", truth_id: str = "truth_id") -> DataFrame:
    """scan, truth_id, covered: the exact share of each truth box that the union of boxes covers (slabs between x edges)."""
    t = truth.select(scan, F.col(truth_id).alias("t_id"), box().alias("t"))
    b = boxes.select(scan, box().alias("b"))
    cut = t.join(b, scan).filter(S.overlap_area(F.col("t"), F.col("b")) > 0).select(scan, "t_id", F.greatest("t.x", "b.x").alias("x0"), F.least(F.expr("t.x + t.w"), F.expr("b.x + b.w")).alias("x1"), F.greatest("t.y", "b.y").alias("y0"), F.least(F.expr("t.y + t.h"), F.expr("b.y + b.h")).alias("y1"))
    edges = cut.select(scan, "t_id", F.explode(F.array("x0", "x1")).alias("x")).distinct()
    slabs = edges.withColumn("next", F.lead("x").over(Window.partitionBy(scan, "t_id").orderBy("x"))).filter("next is not null")
    inside = slabs.join(cut, [scan, "t_id"]).filter("x0 <= x and x1 >= next")
    w = Window.partitionBy(scan, "t_id", "x").orderBy("y0", "y1")
    reach = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = inside.withColumn("reach", reach).withColumn("part", F.greatest(F.col("y1") - F.greatest("y0", F.coalesce("reach", "y0")), F.lit(0)) * (F.col("next") - F.col("x")))
    area = rows.groupBy(scan, "t_id").agg(F.sum("part").alias("area"))
    share = F.coalesce(F.col("area") / (F.col("t.w") * F.col("t.h")), F.lit(0.0))
    return t.join(area, [scan, "t_id"], "left").select(scan, F.col("t_id").alias(truth_id), share.alias("covered"))
