"""Scanned words: every stage against a plain walk through all windows and all pairs of boxes."""

import random
import re

import pytest

from maskline.functions import patterns as P
from maskline.operators import words as W

KIND = "scan_id string, line int, ord long, text string, x int, y int, w int, h int, confidence double"
FOLD = str.maketrans(P.OCR_DIGITS)
NOT_A_VALUE = re.compile(P.NOT_A_VALUE, re.I)


def hits_in(text):
    out = []
    for p in P.SCREEN:
        for m in re.compile(p.regex, re.A | (re.I if p.ignore_case else 0)).finditer(text):
            value = m.group(p.group)
            start = m.start() + (max(m.group(0).find(value), 0) if p.group else 0)
            n, plain = len(re.sub(r"\D", "", value)), value.strip()
            if len(value) < 4 or any(max(start, s) < min(start + len(value), e) for _, _, s, e in out):
                continue
            if p.kind in ("phone", "card") and ("." in value or re.search("[a-zA-Z]", value) or n < (9 if p.kind == "phone" else 13)):
                continue
            if p.kind == "labelled_value" and (len(plain.split()) > 4 or re.search(r"[.?!]$", plain) or NOT_A_VALUE.search(plain)):
                continue
            out.append((p.kind, value.strip(" "), start, start + len(value)))
    return out


def around(ws):
    x, y = min(w["x"] for w in ws), min(w["y"] for w in ws)
    return x, y, max(w["x"] + w["w"] for w in ws) - x, max(w["y"] + w["h"] for w in ws) - y


def at_least(b, w, h):
    return max(b[0], 0), max(b[1], 0), max(b[2], w), max(b[3], h)


def lines(ws):
    out = {}
    for w in sorted(ws, key=lambda w: w["ord"]):
        out.setdefault(w["line"], []).append(w)
    return dict(sorted(out.items()))


def iou(a, b):
    shared = max(min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), 0) * max(min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]), 0)
    return shared / (a[2] * a[3] + b[2] * b[3] - shared)


def by_hand(ws, guards=("identity_card", "vehicle_certificate")):
    found = []

    def add(stage, kind, value, b, px):
        near = any(abs(b[0] - f[3][0]) < px and abs(b[1] - f[3][1]) < px for f in found) if px else any(iou(b, f[3]) > 0.5 for f in found)
        if not near:
            found.append((stage, kind, value, b))

    for line in lines(ws).values():
        text, spans = "", []
        for w in line:
            spans.append((len(text), len(text) + len(w["text"]), w))
            text += w["text"] + " "
        for kind, value, s, e in hits_in(text[:-1]):
            add("line", kind, value, at_least(around([w for a, z, w in spans if a < e and z > s]), 8, 8), 10)
    ordered = sorted(ws, key=lambda w: w["ord"])
    for w in ordered:
        for kind, value, _, _ in hits_in(w["text"]):
            add("word", kind, value, at_least(around([w]), 8, 8), 10)
    for k in (2, 3, 4, 5):
        for i in range(len(ordered) - k + 1):
            run = ordered[i : i + k]
            if around(run)[3] > sum(w["h"] for w in run) / k * 2.2:
                continue
            text = " ".join(w["text"] for w in run)
            for kind, value, _, _ in hits_in(text) + hits_in(text.translate(FOLD)):
                add("window", kind, value, at_least(around(run), 12, 12), 15)
    for name in guards:
        g = W.GUARDS[name]
        if not (any(re.search(g["marks"], " ".join(w["text"] for w in line), re.I | re.A) for line in lines(ws).values()) or any(f[1] in g["kinds"] for f in found)):
            continue
        if g["reasons"][0]:
            for line in lines(ws).values():
                value = " ".join(w["text"] for w in line).strip(" ")
                if value and not re.search(g["line_headers"], value, re.I | re.A):
                    add(f"{name} line", g["kind"], value, at_least(around(line), g["least_width"][0], 12), 15)
        for w in ordered:
            value = w["text"].strip(" ")
            if len(value) > 1 and not re.search(g["word_headers"], value, re.I | re.A):
                add(f"{name} word", g["kind"], value, at_least(around([w]), g["least_width"][1], 12), 10 if g["reasons"][0] else 0)
    return sorted(found)


LINES = [
    ["Government", "of", "India"], ["Name:", "Asha", "Rao", "female"], ["2345", "6789", "O123"], ["234S", "67B9", "0l23", "x"], ["mail", "me", "asha@example.org", "now"], ["dob", "01/02/1990", "ok"],
    ["customer", "John", "Smith", "has", "many", "words", "here."], ["call", "98765", "43210", "or", "+91", "98765", "43211"], ["1234", "5678", "9012", "3456"], ["plain", "words", "only"], ["TN", "01", "AB", "1234"], ["", "x"], ["ABCDE1234F"], ["Regn", "Number", "KA01AB1234"],
]


def scans(seed, n):
    draw, out = random.Random(seed), {}
    for s in range(n):
        ws, y = [], 0
        for number, line in enumerate(draw.sample(LINES, draw.randint(1, 7))):
            x, y = draw.randint(0, 30), y + draw.choice([3, 9, 15, 22])
            for t in line:
                ws.append({"line": number, "ord": len(ws), "text": t, "x": x, "y": y + draw.randint(-2, 2), "w": 7 * len(t) + 1, "h": draw.randint(8, 14)})
                x += draw.choice([4, 12, 7 * len(t) + 9])
        out[f"s{s}"] = ws
    return out


def rows(spark, made):
    return spark.createDataFrame([(s, w["line"], w["ord"], w["text"], w["x"], w["y"], w["w"], w["h"], None) for s, ws in made.items() for w in ws], KIND)


def test_all_stages(spark):
    made = scans(3, 120)
    got = W.scan_words(rows(spark, made)).collect()
    for s, ws in made.items():
        mine = sorted((r["stage"], r["kind"], r["value"], (r["x"], r["y"], r["w"], r["h"])) for r in got if r["scan_id"] == s)
        assert mine == by_hand(ws), s
    assert len({r["stage"] for r in got}) == 6


@pytest.mark.parametrize("block", [5, 16])
def test_blocks_of_words_lose_no_run(spark, block):
    made = {"s": [{"line": 0, "ord": i, "text": t, "x": 20 * i, "y": 5, "w": 15, "h": 10} for i, t in enumerate(["2345", "6789", "0123", "no"] * 20)]}
    got = W.windows(rows(spark, made), block=block)
    assert sorted((r["size"], r["first"]) for r in got.select("size", "first").collect()) == sorted((k, i) for k in (2, 3, 4, 5) for i in range(80 - k + 1))


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("a", 0, 0, None, 1, 1, 5, 5, 90.0), ("a", 0, 1, "x@y.org", 9, 1, 50, 5, 90.4), ("a", 1, 2, "y@y.org", None, 1, 5, 5, None), (None, 0, 0, "z@y.org", 3, 3, 3, 3, None)], KIND)
    got = [(r["scan_id"], r["stage"], r["value"], r["confidence"]) for r in W.line_and_word_hits(df).collect()]
    assert sorted(got, key=repr) == [("a", "line", "x@y.org", 0.85)]
    assert W.scan_words(df.limit(0)).collect() == []


def test_scale(spark):
    df = spark.createDataFrame([("a", 0, 0, "x@y.org", 11, 3, 50, 5, 90.0)], KIND)
    r = W.line_and_word_hits(df, scale=(0.5, 2.5)).first()
    assert (r["x"], r["y"], r["w"], r["h"]) == (6, 8, 25, 13)


def test_codes_read_as_digits_are_found_in_runs(spark):
    df = rows(spark, {"s": [{"line": 0, "ord": i, "text": t, "x": 20 * i, "y": 5, "w": 15, "h": 10} for i, t in enumerate(["see", "THENORBLEll", "there"])]})
    got = [(r["kind"], r["value"], r["x"], r["w"]) for r in W.scan_word_windows(df).collect()]
    assert got == [("ifsc", "THEN0R8LE11", 0, 35), ("ifsc", "THEN0R8LE11", 20, 35)]


def test_lines_are_searched_once(spark):
    lines = W.packed(rows(spark, scans(4, 3)))
    assert W.line_hits(lines)._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
