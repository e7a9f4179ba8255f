"""Recognized words with boxes: what lines, single words and runs of words hold, and whole documents that a mark gives away.

Words: scan_id, line, ord (place in the scan, from 0 without gaps), text, x, y, w, h, and confidence (0 to 100) if there is one. Lines
are rebuilt from words. Boxes are scaled to the viewport and rounded half up. Hits: scan_id, stage, ord (order within the stage),
kind, value, reason, x, y, w, h, confidence.

Words are gathered by line once and written out; every stage reads that. A stage leaves out what lies near an earlier stage's hit and, in
order, near a kept hit of its own in one walk over grid cells: no two sets of a scan's boxes are ever paired as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskline.functions import patterns as P
from maskline.functions import scalars as S
from maskline.functions import scan as X
from maskline.functions.groups import kept_rows, numbers
from maskline.functions.scan import looks_right
from maskline.operators.discover import with_findings
from maskline.plans.session import ship
from maskline.sources.tables import stored

#: Words of a run at most, and of the block of a scan that one task looks at; runs that begin in a block read on into the next.
LONGEST, BLOCK = 5, 4096
#: A run's words stand on one line if together they are at most so many mean heights tall.
SPREAD = 2.2
#: Scans that may be sent to all tasks as marked; more are joined by a shuffle.
BROADCAST_SCANS = 1_000_000
HIT = ["kind", "value", "reason", "x", "y", "w", "h", "confidence"]

#: What marks a document (of mark_words one stands in each mark), whose hits mark it, which of its lines and words aren't covered, and how (fixed values).
GUARDS = {
    "identity_card": {
        "marks": r"aadhaar|uidai|government of india|mera aadhaar|unique identification|help@uidai|my aadhaar",
        "mark_words": ("aadhaar", "uidai", "government", "unique"),
        "kinds": ["aadhaar", "vid"],
        "line_headers": r"^(government of india|bharat sarkar|mera aadhaar|meri pehchan|my aadhaar|unique identification authority)[\s,.:/-]*$",
        "word_headers": r"^(government|govt|of|india|bharat|sarkar|mera|aadhaar|meri|pehchan|unique|identification|authority|uidai|help|www|gov|in|enrollment|download)$",
        "kind": "aadhaar_card_pii",
        "reasons": ("aadhaar_card_field", "aadhaar_card_word"),
        "least_width": (16, 14),
    },
    "vehicle_certificate": {
        "marks": r"vehicle registration|registration certificate|government of \w+|chassis number|engine\/motor|regn\.?\s*number|motor vehicles department",
        "mark_words": ("vehicle", "registration", "government", "chassis", "motor", "regn"),
        "kinds": ["vehicle_reg", "chassis_number"],
        "word_headers": r"^(indian|union|vehicle|registration|certificate|issued|by|government|of|tamil|nadu|fuel|petrol|diesel|c|te|norms|emission|bharat|stage|vi)$",
        "kind": "vehicle_rc_pii",
        "reasons": (None, "vehicle_rc_word"),
        "least_width": (None, 12),
    },
}


def sound(words: DataFrame) -> DataFrame:
    """The words that have a scan, a place and a box; others are left out."""
    return words.dropna(subset=["scan_id", "line", "ord", "x", "y", "w", "h"])


def lines_of(words: DataFrame) -> DataFrame:
    """scan_id, line, text, words: each line's words in order, with start, their offset in the text, and sure, their confidence (85 if
    there is none). One shuffle by line."""
    line = Window.partitionBy("scan_id", "line")
    text = F.coalesce("text", F.lit(""))
    start = F.coalesce(F.sum(F.length(text) + 1).over(line.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    sure = F.coalesce(F.nullif(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(85.0)) if "confidence" in words.columns else F.lit(85.0)
    word = F.struct(F.col("ord"), text.alias("text"), "x", "y", "w", "h", F.col("_start").alias("start"), sure.alias("sure"))
    rows = words.withColumn("_start", start).groupBy("scan_id", "line").agg(F.array_sort(F.collect_list(word)).alias("words"))
    return rows.select("scan_id", "line", F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text"), "words")


def packed(words: DataFrame) -> DataFrame:
    """lines_of() the words, written out: what all stages read."""
    return stored(lines_of(sound(words)), "lines")


def words_of(lines: DataFrame) -> DataFrame:
    return lines.select("scan_id", "line", F.inline("words"))


def union_box(words: Column) -> Column:
    """The least box around an array of words."""
    x, y = F.array_min(F.transform(words, lambda w: w["x"])), F.array_min(F.transform(words, lambda w: w["y"]))
    right, bottom = F.array_max(F.transform(words, lambda w: w["x"] + w["w"])), F.array_max(F.transform(words, lambda w: w["y"] + w["h"]))
    return F.named_struct(F.lit("x"), x, F.lit("y"), y, F.lit("w"), right - x, F.lit("h"), bottom - y)


def scaled(b: Column, scale: tuple[float, float], least: tuple[int, int]) -> list[Column]:
    """x, y, w, h in the viewport: at least 0, and at least so wide and tall."""
    at = lambda c, s, low: F.greatest(F.lit(low), F.floor(b[c] * s + 0.5)).cast("int").alias(c)
    return [at("x", scale[0], 0), at("y", scale[1], 0), at("w", scale[0], least[0]), at("h", scale[1], least[1])]


def claims(df: DataFrame, patterns: list[P.Pattern]) -> DataFrame:
    """df (text) with findings: all hits, earlier patterns first, that hold what they seem to; digits of other scripts count."""
    return with_findings(df, "text", patterns, 4, normalize=True, keep=looks_right, claims=True)


def may_hit(patterns: list[P.Pattern]) -> str:
    """A pattern that every text with a hit fits: marks of credentials, an "@", enough digits, the words that values follow."""
    wanted = {"labelled_value": rf"(?i)\b(?:{P.VALUE_LABEL})", "phone": r"\d(?:\D*\d){8}", "vid": r"\d{4}", "ssn": r"\d{4}"}
    hints = [P.java(wanted[p.kind]) if p.kind in wanted else p.hint for p in patterns]
    return "|".join(dict.fromkeys(f"(?i:{h[4:]})" if h.startswith("(?i)") else h for h in hints))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with ord, the given columns as one sortable value."""
    return df.withColumn("ord", F.array(*(F.col(c).cast("long") for c in order))).drop(*order)


def crowded(x: np.ndarray, y: np.ndarray, px: int) -> np.ndarray:
    """Whether another corner lies in the cell of each one or in a cell around it."""
    if len(x) < 32:
        return np.ones(len(x), bool)
    cx, cy = np.floor(x / px).astype(np.int64), np.floor(y / px).astype(np.int64)
    high = int(cy.max() - cy.min()) + 3
    key = (cx - cx.min()) * high + cy - cy.min() + 1
    cells, n = np.unique(key, return_counts=True)
    total = np.zeros(len(x), np.int64)
    for shift in (dx * high + dy for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
        at = np.minimum(np.searchsorted(cells, key + shift), len(cells) - 1)
        total += np.where(cells[at] == key + shift, n[at], 0)
    return total > 1


def apart(x: np.ndarray, y: np.ndarray, own: np.ndarray, px: int) -> list[int]:
    """In order, the own corners that aren't within less than px, both ways, of one of the others, which come first, or of a kept one."""
    close, grid = crowded(x, y, px), {}
    kept, walked = np.flatnonzero(own & ~close).tolist(), np.flatnonzero(close)
    for i, left, top, mine in zip(walked.tolist(), x[walked].tolist(), y[walked].tolist(), own[walked].tolist()):
        cx, cy = left // px, top // px
        around = (p for dx in (-1, 0, 1) for dy in (-1, 0, 1) for p in grid.get((cx + dx, cy + dy), ()))
        if not mine or not any(abs(px_ - left) < px and abs(py_ - top) < px for px_, py_ in around):
            grid.setdefault((cx, cy), []).append((left, top))
            kept += [i] if mine else []
    return kept


def kept_apart(hits: DataFrame, px: int, others: DataFrame | None = None) -> DataFrame:
    """In order, the hits whose corner isn't within less than px, both ways, of the corner of one of the others in their scan, or of
    a kept one. One shuffle by scan."""
    rows = hits.select("scan_id", "ord", *HIT, F.lit(True).alias("_own"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"))
    if others is not None:
        at = {"scan_id": F.col("scan_id"), "_own": F.lit(False), "_x": F.col("x").cast("double"), "_y": F.col("y").cast("double")}
        known = others.dropna(subset=["x", "y"]).select(*(at.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema)).distinct()
        rows = rows.unionByName(known)

    def choose(b: dict[str, np.ndarray]) -> list[int]:
        return apart(b["_x"], b["_y"], b["_own"] > 0, px)

    return kept_rows(rows, "scan_id", [F.col("_own"), F.col("ord"), *(F.col(c) for c in HIT)], choose, ["_x", "_y", "_own"]).select("scan_id", "ord", *HIT)


def line_hits(lines: DataFrame, patterns: list[P.Pattern] = P.SCREEN, scale: tuple[float, float] = (1.0, 1.0), px: int = 10) -> DataFrame:
    """Hits of whole packed lines, boxed by the words that they touch. A hit's span in the line's text tells its words by their offsets."""
    # the outer form: for the inner one the optimizer adds a filter on the array's size, which searches the texts again
    rows = claims(lines.filter("text <> ''"), patterns).select("scan_id", "line", "text", "words", F.posexplode_outer("findings").alias("n", "f")).filter("f is not null")
    span = F.filter("words", lambda w: (w["start"] < F.col("f.start") + F.col("f.length")) & (w["start"] + F.length(w["text"]) > F.col("f.start")))
    rows = rows.withColumn("_b", union_box(span)).select("scan_id", "line", "n", *_hit("ocr_pii_match"), *scaled(F.col("_b"), scale, (8, 8)), F.lit(0.85).alias("confidence"))
    return kept_apart(numbered(rows, ["line", "n"]).select("scan_id", "ord", *HIT), px)


def word_hits(lines: DataFrame, others: DataFrame, patterns: list[P.Pattern] = P.SCREEN, scale: tuple[float, float] = (1.0, 1.0), px: int = 10) -> DataFrame:
    """Hits of the single words of packed lines that aren't within px of one of the others."""
    rows = words_of(lines).filter("text <> ''").select("scan_id", F.col("ord").alias("line"), "text", F.struct("x", "y", "w", "h").alias("_b"), (F.floor(F.col("sure") + 0.5) / 100).alias("confidence"))
    rows = claims(rows, patterns).select("scan_id", "line", "text", "_b", "confidence", F.posexplode_outer("findings").alias("n", "f")).filter("f is not null")
    rows = rows.select("scan_id", "line", "n", *_hit("ocr_pii_match"), *scaled(F.col("_b"), scale, (8, 8)), "confidence")
    return kept_apart(numbered(rows, ["line", "n"]).select("scan_id", "ord", *HIT), px, others)


def _hit(reason: str) -> list[Column]:
    return [F.col("f.kind").alias("kind"), F.trim(F.substr("text", F.col("f.start") + 1, F.col("f.length"))).alias("value"), F.lit(reason).alias("reason")]


def line_and_word_hits(words: DataFrame, patterns: list[P.Pattern] = P.SCREEN, scale: tuple[float, float] = (1.0, 1.0), px: int = 10) -> DataFrame:
    """Hits of whole lines; then of single words that aren't within px of a hit. Null texts are empty; words without a scan or box are left out."""
    return _line_and_word_hits(packed(words), patterns, scale, px)


def _line_and_word_hits(lines: DataFrame, patterns: list[P.Pattern], scale: tuple[float, float], px: int = 10) -> DataFrame:
    first = stored(line_hits(lines, patterns, scale, px), "line_hits")
    return first.withColumn("stage", F.lit("line")).unionByName(word_hits(lines, first, patterns, scale, px).withColumn("stage", F.lit("word")))


def dealt(words: DataFrame, longest: int = LONGEST, block: int = BLOCK) -> DataFrame:
    """The words with _block: a scan is dealt out in blocks of words; the first words of a block also go to the one before, so runs across
    blocks are whole and a scan with most words isn't one task's. A run is of the block that it begins in."""
    at = F.floor(F.col("ord") / block)
    to = F.when((F.col("ord") % block < longest - 1) & (at > 0), F.array(at, at - 1)).otherwise(F.array(at))
    return words.select("scan_id", F.explode(to).alias("_block"), "ord", F.coalesce("text", F.lit("")).alias("text"), "x", "y", "w", "h")


def windows(words: DataFrame, longest: int = LONGEST, block: int = BLOCK) -> DataFrame:
    """scan_id, size, first (ord): every run of 2 to `longest` consecutive words that stand on one line."""
    ship(words.sparkSession)

    def runs(t: pa.Table, upto: int) -> pa.Table:
        parts = [(size, at) for size, ok in one_line(t, longest, block).items() for at in [np.flatnonzero(ok[:upto])]]
        at = np.concatenate([x for _, x in parts])
        sizes = np.concatenate([np.full(len(x), size) for size, x in parts])
        return pa.Table.from_arrays([t["scan_id"].combine_chunks().take(pa.array(at)), pa.array(sizes, pa.int32()), t["ord"].combine_chunks().take(pa.array(at)).cast(pa.int64())], ["scan_id", "size", "first"])

    rows = dealt(words, longest, block)
    kind = rows.schema["scan_id"].dataType.simpleString()
    return _in_stretches(rows, longest, runs, f"scan_id {kind}, size int, first long")


#: Rows of words that a task looks at together.
STRETCH = 32_768


def _in_stretches(rows: DataFrame, longest: int, work, schema: str) -> DataFrame:
    """What work makes of the dealt words in order, some at a time: it gets rows and how many of them runs may begin at; the rows after
    them are of runs alone and come again."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            n += len(b)
            if n >= STRETCH:
                t = pa.concat_tables(held)
                yield from work(t, n - longest + 1).combine_chunks().to_batches(4096)
                held, n = [t.slice(n - longest + 1)], longest - 1
        if n:
            yield from work(pa.concat_tables(held), n).combine_chunks().to_batches(4096)

    return rows.repartition("scan_id", "_block").sortWithinPartitions("scan_id", "_block", "ord").mapInArrow(each, schema)


def one_line(t: pa.Table, longest: int, block: int) -> dict[int, np.ndarray]:
    """For each size, of which rows the run of so many words is whole, of its own block, and on one line."""
    of, own, ords = t["scan_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False), t["_block"].to_numpy(), t["ord"].to_numpy()
    y, h, n = numbers(t, "y"), numbers(t, "h"), len(t)
    begins, top, bottom, total, out = ords // block == own, y.copy(), y + h, h.copy(), {}
    for size in range(2, longest + 1):
        m = max(n - size + 1, 0)
        top, bottom, total = np.minimum(top[:m], y[n - m :]), np.maximum(bottom[:m], (y + h)[n - m :]), total[:m] + h[n - m :]
        ok = np.zeros(n, bool)
        ok[:m] = begins[:m] & (of[:m] == of[n - m :]) & (own[:m] == own[n - m :]) & (bottom - top <= total / size * SPREAD)
        out[size] = ok
    return out


LABEL_FIRST = "".join(sorted({y for x in P.VALUE_LABEL.split("|") for y in (x[0].lower(), x[0].upper())}))


@lru_cache(maxsize=256)
def run_start(regex: str, hint: str) -> re.Pattern:
    """What every run with a hit fits somewhere; words before and after the run don't undo that."""
    if X.LABELS.match(regex):
        return re.compile(rf"[{LABEL_FIRST}](?<![A-Za-z0-9_].)(?<=(?=(?i:{P.java(P.VALUE_LABEL)})).)", re.ASCII)
    return X.start_of(regex, hint)


def run_hits(t: pa.Table, upto: int, patterns: list[P.Pattern], block: int) -> list[tuple]:
    """row, size, form (0: as it is, 1: letters read as digits), n, kind, value of the hits of runs. All words are passed over as one text for
    places where a hit may start; a pattern is tried on the runs that hold such a place alone."""
    ok, texts, out = one_line(t, LONGEST, block), t["text"].to_pylist(), []
    for form in (0, 1):
        forms = [x.translate(OCR) for x in texts] if form else texts
        plain = [X.normalized(x) for x in forms]
        whole = " ".join(plain)
        if "\x01" in whole or "\x02" in whole:
            plain = [x.translate(X.MARKS) for x in plain]
            whole = " ".join(plain)
        ends, tried = np.cumsum([len(x) + 1 for x in plain]), {}
        for rank, p in enumerate(patterns):
            at = np.unique(np.searchsorted(ends, [q.start() for q in run_start(p.regex, p.hint).finditer(whole)], "right")).astype(np.int64)
            for size in range(2, LONGEST + 1):
                first = np.unique((at[:, None] - np.arange(size)).ravel())
                first = first[(first >= 0) & (first < upto)]
                for i in first[ok[size][first]].tolist():
                    tried.setdefault((i, size), []).append(rank)
        for (i, size), ranks in tried.items():
            text, raw = " ".join(plain[i : i + size]), " ".join(forms[i : i + size])
            if form and raw == " ".join(texts[i : i + size]):
                continue  # the same hits in the same box have been found
            rows = []
            for rank in ranks:
                p = patterns[rank]
                for m in X.searcher(p.regex, p.ignore_case, p.hint)(text):
                    if len(value := m[p.group]) >= 4:
                        rows.append((rank, p, value, m.start() + (m[0].find(value) if p.group else 0)))
            for n, f in enumerate(X.unclaimed([f for f in rows if looks_right(f)])):
                out.append((i, size, form, n, f[1].kind, raw[f[3] : f[3] + len(f[2])].strip(" ")))
    return out


OCR = {ord(k): v for k, v in P.OCR_DIGITS.items()}


def scan_word_windows(words: DataFrame, existing: DataFrame | None = None, patterns: list[P.Pattern] = P.SCREEN, scale: tuple[float, float] = (1.0, 1.0), px: int = 15, block: int = BLOCK) -> DataFrame:
    """Hits of runs of 2 to 5 consecutive words on one line, as they are and with letters read as digits; the box is the run's.

    All sizes are made in one pass, shorter runs first. Hits within px of an existing hit, or of one before, go."""
    ship(words.sparkSession)

    def hits(t: pa.Table, upto: int) -> pa.Table:
        rows = run_hits(t, upto, patterns, block)
        x, y, right, bottom = (v.tolist() for v in (numbers(t, "x"), numbers(t, "y"), numbers(t, "x") + numbers(t, "w"), numbers(t, "y") + numbers(t, "h")))
        boxes = []
        for i, size, *_ in rows:
            left, top = min(x[i : i + size]), min(y[i : i + size])
            boxes.append((left, top, max(right[i : i + size]) - left, max(bottom[i : i + size]) - top))
        at = pa.array([r[0] for r in rows], pa.int64())
        values = [t["scan_id"].combine_chunks().take(at), t["ord"].combine_chunks().take(at).cast(pa.int64())]
        values += [pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.int32()), (4, pa.string()), (5, pa.string()))]
        values += [pa.array([b[k] for b in boxes], pa.float64()) for k in range(4)]
        return pa.Table.from_arrays(values, ["scan_id", "first", "size", "form", "n", "kind", "value", "x", "y", "w", "h"])

    rows = dealt(sound(words), block=block)
    kind = rows.schema["scan_id"].dataType.simpleString()
    rows = _in_stretches(rows, LONGEST, hits, f"scan_id {kind}, first long, size int, form int, n int, kind string, value string, x double, y double, w double, h double")
    rows = rows.withColumn("_b", F.struct("x", "y", "w", "h")).drop("x", "y", "w", "h")
    rows = rows.select("scan_id", "size", "first", "form", "n", "kind", "value", F.lit("ocr_multiword_pii").alias("reason"), *scaled(F.col("_b"), scale, (12, 12)), F.lit(0.92).alias("confidence"))
    return kept_apart(numbered(rows, ["size", "first", "form", "n"]).select("scan_id", "ord", *HIT), px, existing).withColumn("stage", F.lit("window"))


def marked_scans(lines: DataFrame, hits: DataFrame, guard: str) -> DataFrame:
    """scan_id of the scans that a line's text or a hit's kind marks."""
    g = GUARDS[guard]
    by_text = lines.filter(F.col("text").rlike(P.java(g["marks"], True))).select("scan_id")
    return by_text.union(hits.filter(F.col("kind").isin(*g["kinds"])).select("scan_id")).distinct()


def document_guard(words: DataFrame, hits: DataFrame, guard: str, scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """If a line or a hit marks a scan as such a document, everything on it but its headers: scan_id, ord, HIT, stage.

    Identity cards: lines, 15 pixels from any hit, then words of two letters and more, 10 pixels from any. Vehicle certificates: words
    that no hit covers by an IoU above 0.5. Only marked scans' words are read again: the marked ids go to all tasks if they were
    counted as few, else they are joined by a shuffle."""
    return guarded(packed(words), hits, guard, scale)


def guarded(packed_lines: DataFrame, hits: DataFrame, guard: str, scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    g = GUARDS[guard]
    marked = stored(marked_scans(packed_lines, hits, guard), "marked")
    marked = F.broadcast(marked) if marked.count() <= BROADCAST_SCANS else marked
    own, before = packed_lines.join(marked, "scan_id", "left_semi"), hits.join(marked, "scan_id", "left_semi").select("scan_id", "x", "y", "w", "h")
    out = None
    if g["reasons"][0]:
        lines = own.withColumn("value", F.trim("text")).filter((F.col("value") != "") & ~F.col("value").rlike(P.java(g["line_headers"], True)))
        lines = lines.withColumn("_b", union_box(F.col("words"))).select("scan_id", "line", F.lit(g["kind"]).alias("kind"), "value", F.lit(g["reasons"][0]).alias("reason"), *scaled(F.col("_b"), scale, (g["least_width"][0], 12)), F.lit(0.95).alias("confidence"))
        lines = numbered(lines.withColumn("n", F.lit(0)), ["line", "n"]).select("scan_id", "ord", *HIT)
        lines = stored(kept_apart(lines, 15, before), "guarded")
        before, out = before.unionByName(lines.select("scan_id", "x", "y", "w", "h")), lines.withColumn("stage", F.lit(f"{guard} line"))
    word = words_of(own).withColumn("value", F.trim("text")).filter((F.length("value") > 1) & ~F.col("value").rlike(P.java(g["word_headers"], True)))
    word = word.withColumn("_b", F.struct("x", "y", "w", "h")).select("scan_id", F.col("ord").alias("line"), F.lit(0).alias("n"), F.lit(g["kind"]).alias("kind"), "value", F.lit(g["reasons"][1]).alias("reason"), *scaled(F.col("_b"), scale, (g["least_width"][1], 12)), F.lit(0.95).alias("confidence"))
    word = numbered(word, ["line", "n"]).select("scan_id", "ord", *HIT)
    if g["reasons"][0]:
        word = kept_apart(word, 10, before)
    else:
        word = uncovering(uncovered(word, before))
    word = word.withColumn("stage", F.lit(f"{guard} word"))
    return word if out is None else out.unionByName(word)


CELL = 64


def uncovered(hits: DataFrame, others: DataFrame) -> DataFrame:
    """The hits whose IoU with none of the others of their scan is above a half. They meet in the cell of their middle: two boxes of
    such an IoU hold each other's middle, so the other one's cells include it."""
    b = others.filter("w > 0 and h > 0").distinct()
    xs, ys = (F.sequence(F.floor(F.col(c) / CELL), F.floor((F.col(c) + F.col(s)) / CELL)) for c, s in (("x", "w"), ("y", "h")))
    b = b.select(F.col("scan_id").alias("_scan"), F.struct("x", "y", "w", "h").alias("_o"), F.explode(xs).alias("_cx"), ys.alias("_ys")).select("_scan", "_o", "_cx", F.explode("_ys").alias("_cy")).alias("o")
    a = hits.withColumns({"_cx": F.floor((F.col("x") + F.col("w") / 2) / CELL), "_cy": F.floor((F.col("y") + F.col("h") / 2) / CELL), "_b": F.struct("x", "y", "w", "h")}).alias("a")
    near = (F.col("a.scan_id") == F.col("_scan")) & (F.col("a._cx") == F.col("o._cx")) & (F.col("a._cy") == F.col("o._cy")) & (S.iou(F.col("_b"), F.col("_o")) > 0.5)
    return a.join(b, near, "left_anti").drop("_cx", "_cy", "_b")


def uncovered_of(b: dict[str, np.ndarray], own: np.ndarray | None = None) -> list[int]:
    """In order, the own boxes whose IoU with none of the others, which come first, nor with a kept one is above a half."""
    kept, grid = [], {}
    x, y, w, h = (b[c].tolist() for c in "xywh")
    mine = [True] * len(x) if own is None else own.tolist()
    for i in range(len(x)):
        for j in grid.get(((x[i] + w[i] / 2) // CELL, (y[i] + h[i] / 2) // CELL), ()) if mine[i] else ():
            shared = max(min(x[i] + w[i], x[j] + w[j]) - max(x[i], x[j]), 0) * max(min(y[i] + h[i], y[j] + h[j]) - max(y[i], y[j]), 0)
            if 2 * shared > w[i] * h[i] + w[j] * h[j] - shared:
                break
        else:
            kept += [i] if mine[i] else []
            for cx in range(int(x[i] // CELL), int((x[i] + w[i]) // CELL) + 1):
                for cy in range(int(y[i] // CELL), int((y[i] + h[i]) // CELL) + 1):
                    grid.setdefault((cx, cy), []).append(i)
    return kept


def uncovering(boxes: DataFrame) -> DataFrame:
    """In order (ord), the boxes whose IoU with no kept one of their scan is above a half."""

    return kept_rows(boxes, "scan_id", [F.col("ord"), *(F.col(c) for c in HIT)], uncovered_of, ["x", "y", "w", "h"])


def scan_words(words: DataFrame, patterns: list[P.Pattern] = P.SCREEN, scale: tuple[float, float] = (1.0, 1.0), guards: tuple[str, ...] = tuple(GUARDS)) -> DataFrame:
    """All stages in turn: lines, words, runs of words, then the guards; each leaves out what the ones before have."""
    lines = packed(words)
    hits = stored(_line_and_word_hits(lines, patterns, scale), "hits")
    hits = hits.unionByName(stored(scan_word_windows(words_of(lines), hits, patterns, scale), "windows"))
    for guard in guards:
        hits = hits.unionByName(stored(guarded(lines, hits, guard, scale), "guard"))
    return hits
