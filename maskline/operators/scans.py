"""Scans that come whole, one in a row: every stage of operators.words inside the task that has the row. Nothing is shuffled or written.

Results are those of operators.words, where scans come as rows of words. Rows are read some at a time, by characters; each row is a scan of
its own. All words are passed over as one text, as numbers, for the places where a hit may start; a pattern is tried there alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from maskline.functions import patterns as P
from maskline.functions import scan as X
from maskline.functions.scan import looks_right
from maskline.operators import words as W
from maskline.plans.session import ship
from maskline.sources.tables import spread

#: Bytes of the rows that are looked at together (a longer row alone).
STRETCH = 1 << 20
SCHEMA = "stage string, kind string, value string, reason string, x int, y int, w int, h int, confidence double"
KINDS = [pa.string()] * 4 + [pa.int32()] * 4 + [pa.float64()]


@dataclass
class Words:
    """Words in order: the place of their row, line, ord, box, confidence, text."""

    scan: np.ndarray
    line: np.ndarray
    ord: np.ndarray
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    h: np.ndarray
    sure: np.ndarray
    texts: list[str]

    def sorted(self, *keys: str) -> Words:
        order = np.lexsort([getattr(self, k) for k in reversed(keys)])
        if (order[1:] > order[:-1]).all():
            return self
        return Words(*(getattr(self, k)[order] for k in ("scan", "line", "ord", "x", "y", "w", "h", "sure")), [self.texts[i] for i in order.tolist()])


def of_texts(rows: pa.Table, across: int, down: int, wide: int, high: int) -> Words:
    """The words of `text`, laid out: pixels across and wide a character, down a line, and the height of words. Blanks part words, line feeds lines."""
    texts, counts, line, scan = [], [], [], []
    for at, t in enumerate(rows["text"].to_pylist()):
        for blank in "\t\r\x0b\f":
            if t and blank in t:
                t = t.replace(blank, " ")
        for k, row in enumerate((t or "").split("\n")):
            own = row.split(" ")
            if "" in own:
                own = list(filter(None, own))
            if own:
                texts += own
                counts.append(len(own)), line.append(k), scan.append(at)
    n = np.array(counts, np.int64)
    line, scan = (np.repeat(np.array(a, np.int64), n) for a in (line, scan))
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    left = np.cumsum(size + 1) - size - 1
    left -= np.repeat(left[np.cumsum(n) - n], n)
    ord_ = np.arange(len(texts)) - np.searchsorted(scan, scan)
    return Words(scan, line, ord_, *(a.astype(np.float64) for a in (left * across, line * down, size * wide, np.full(len(texts), high))), np.full(len(texts), 85.0), texts)


def of_words(rows: pa.Table) -> Words:
    """The words of the array `words` (line, ord, text, x, y, w, h, confidence); those without a place or a box are left out."""
    at = [(i, w) for i, ws in enumerate(rows["words"].to_pylist()) for w in ws or () if w and None not in (w["line"], w["ord"], w["x"], w["y"], w["w"], w["h"])]
    whole = [np.array([w[c] for _, w in at], np.int64) for c in ("line", "ord")]
    boxes = [np.array([w[c] for _, w in at], np.float64) for c in "xywh"]
    sure = np.array([float(w.get("confidence") or 85.0) for _, w in at], np.float64)
    return Words(np.array([i for i, _ in at], np.int64), *whole, *boxes, sure, [w["text"] or "" for _, w in at]).sorted("scan", "line", "ord")


# --- where hits may start ---
DOB, GENDER, CHASSIS, LABELLED = (next(p.regex for p in P.SCREEN if p.kind == k) for k in ("dob", "gender", "chassis_number", "labelled_value"))
#: Hits of these, or what their hints look for, stand in runs of at least LEAST characters of CODE (numbers, capitals, blanks and marks) with so
#: many digits at least, and of so many characters.
CODES = {P.CARD: (16, 16), P.SSN: (9, 9), P.VID: (16, 16), P.AADHAAR: (12, 12), P.PAN: (4, 10), P.GSTIN: (6, 15), P.PASSPORT: (7, 8), P.IFSC: (1, 11), P.LICENCE: (13, 15), P.VEHICLE: (5, 8), P.PHONE: (9, 9), DOB: (6, 8), CHASSIS: (0, 17)}
LEAST, BLANKS = 8, " \t\n\x0b\f\r\xa0"
OTHER_BLANKS = {*"     　﻿", *map(chr, range(0x2000, 0x200B))}
#: Characters as bytes, one for each; those that aren't one are this.
OTHER = ord("?")
CODE = np.isin(np.arange(256), [*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-().+/", *map(ord, BLANKS)])
LETTER = np.isin(np.arange(256), [*b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"])
LOW = np.array([ord(chr(i).lower()) if i < 128 else i for i in range(256)], np.uint32)
AFTER_ID, AFTER_ROLE = (tuple(chr(i) for i in (*map(ord, f"{x}-{BLANKS}"), OTHER)) for x in ("0123456789", ""))
#: The first three characters of hits, no letter, digit or "_" before them; "id" and "hr" are followed by little else.
HEADS = {
    GENDER: ["mal", "fem", "tra"],
    P.ACCOUNT: ["a/c", "acc", "ban"],
    P.EMPLOYEE: ["isr", "nas", "esa", "drd", "bar", "emp", "sta", *(f"id{x}" for x in AFTER_ID)],
    P.ROLE_NAME: ["adm", "lea", "dir", "off", "man", "emp", "sta", *(f"hr{x}" for x in AFTER_ROLE)],
    LABELLED: sorted({x[:3] for x in P.VALUE_LABEL.split("|")}),
}
#: These stand anywhere.
ANYWHERE = {GENDER: ["पुरुष", "महिला"]}
OCR_BYTES = np.array([ord(P.OCR_DIGITS.get(chr(i), chr(i))) for i in range(256)], np.uint8)


def as_bytes(text: str) -> tuple[np.ndarray, set[str]]:
    """The text's characters as bytes, and which ones stand in it that aren't one."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8), set()
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        return np.where(codes < 256, codes, OTHER).astype(np.uint8), {chr(c) for c in np.unique(codes[codes > 255]).tolist()}


def as_digits(text: str) -> str:
    """The text with the letters read as digits that scanners read in place of some."""
    try:
        return text.encode("latin-1").translate(OCR_BYTES.tobytes()).decode("latin-1")
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").copy()
        codes[codes < 256] = OCR_BYTES[codes[codes < 256]]
        return codes.tobytes().decode("utf-32-le")


def code_runs(flat: np.ndarray, others: set[str]) -> np.ndarray:
    """Where the runs of CODE of at least LEAST characters begin and end, and how many digits they have: rows."""
    code = CODE[flat] | (flat == OTHER) if others & OTHER_BLANKS else CODE[flat]
    for step in (1, 2, 4):  # whether a run of twice as many begins here
        code = code[:-step] & code[step:]
    at = np.flatnonzero(code)
    cuts = np.flatnonzero(np.diff(at) > 1)
    low, high = at[np.concatenate([at[:1] * 0, cuts + 1])], at[np.concatenate([cuts, at[:1] * 0 + len(at) - 1])] + LEAST
    digits = np.flatnonzero(flat - np.uint8(48) < 10)
    return np.stack([low, high, np.searchsorted(digits, high) - np.searchsorted(digits, low)], 1)


@lru_cache(maxsize=1)
def head_bits() -> np.ndarray:
    """By three bytes: of which patterns with heads they are one."""
    bits = np.zeros(1 << 24, np.uint8)
    for k, heads in enumerate(HEADS.values()):
        for a, b, c in (map(ord, h) for h in heads):
            bits[a << 16 | b << 8 | c] |= 1 << k
    return bits


def head_places(flat: np.ndarray) -> dict[str, np.ndarray]:
    """By regex, where its heads stand."""
    own = LETTER[flat]
    at = np.flatnonzero(own[1:-2] & ~own[:-3]) + 1
    at = np.concatenate([[0], at]) if len(flat) > 2 and own[0] else at
    low = [LOW[flat[at + k]] for k in range(3)]
    bits = head_bits()[low[0] << 16 | low[1] << 8 | low[2]]
    return {regex: at[bits & (1 << k) > 0] for k, regex in enumerate(HEADS)}


def finds(text: str | bytes, part: str | bytes) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


@lru_cache(maxsize=256)
def whole_hit(regex: str, ignore_case: bool) -> re.Pattern:
    return re.compile(P.java(regex, ignore_case), re.ASCII)


LITERAL = re.compile(r"[A-Za-z0-9 :/_@-]+")


class Sought:
    """Words as one text, as it is and with digits of other scripts normalized, and the words in which a hit of a pattern may start."""

    def __init__(self, raw: str, starts: np.ndarray, ends: np.ndarray, patterns: tuple[P.Pattern, ...]):
        self.raw, self.starts, self.ends, self.patterns = raw, starts, ends, patterns
        flat, others = as_bytes(raw)
        self.text = X.normalized(raw) if others else raw
        if "\x01" in raw or "\x02" in raw:
            self.text = self.text.translate(X.MARKS)
        if self.text is not raw:
            flat, others = as_bytes(self.text)
        runs, heads = code_runs(flat, others), head_places(flat)
        self.flat, self.places = flat, [np.unique(np.searchsorted(ends, list(self._starts(p, runs, heads)), "right")).astype(np.int64) for p in patterns]

    def _starts(self, p: P.Pattern, runs: np.ndarray, heads: dict[str, np.ndarray]) -> Iterator[int]:
        if p.regex in HEADS:
            full = whole_hit(p.regex, p.ignore_case)
            yield from (i for i in heads[p.regex].tolist() if full.match(self.text, i))
            for part in ANYWHERE.get(p.regex, ()):
                yield from finds(self.text, part)
        elif p.regex in CODES:
            quick, (digits, least) = X.start_of(p.regex, p.hint), CODES[p.regex]
            own = runs[(runs[:, 2] >= digits) & (runs[:, 1] - runs[:, 0] >= least), :2].tolist()
            yield from (q.start() for low, high in own for q in quick.finditer(self.text, low, high))
        elif p.regex in X.AT_REGEXES or p.regex not in X.STARTS and LITERAL.fullmatch(p.hint):
            yield from finds(self.text, "@" if p.regex in X.AT_REGEXES else p.hint)
        else:
            yield from (q.start() for q in W.run_start(p.regex, p.hint).finditer(self.text))

    def hits(self, first: int, last: int, ranks: list[int]) -> list[tuple]:
        """rank, pattern, value, start of the hits of words first to last as one text: as chosen() of functions.scan."""
        text, rows = self.text[self.starts[first] : self.ends[last]], []
        for rank in ranks:
            p = self.patterns[rank]
            for m in X.searcher(p.regex, p.ignore_case, p.hint)(text):
                if len(value := m[p.group]) >= 4:
                    rows.append((rank, p, value, m.start() + (m[0].find(value) if p.group else 0)))
        return X.unclaimed([f for f in rows if looks_right(f)])

    def value(self, first: int, f: tuple) -> str:
        at = int(self.starts[first]) + f[3]
        return self.raw[at : at + len(f[2])].strip(" ")


def ranks_of(places: list[np.ndarray]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for rank, at in enumerate(places):
        for i in at.tolist():
            out.setdefault(i, []).append(rank)
    return out


# --- stages ---
def scaled(box: list | np.ndarray, scale: tuple[float, float], least: tuple[int, int]) -> np.ndarray:
    """Boxes in the viewport: at least 0, and at least so wide and tall."""
    return np.maximum(np.floor(np.asarray(box, np.float64).reshape(-1, 4) * np.array([*scale, *scale]) + 0.5), (0, 0, *least))


class Hits:
    """Hits of all scans of a stretch: their scans and boxes as arrays, and what else is returned."""

    def __init__(self, stage: str, reason: str, scan: list | np.ndarray, kinds: list[str] | str, values: list[str], box: np.ndarray, scale: tuple[float, float], least: tuple[int, int], confidence: list | np.ndarray | float):
        n = len(values)
        self.scan, self.stage, self.reason, self.values = np.asarray(scan, np.int64), stage, reason, values
        self.kinds = [kinds] * n if isinstance(kinds, str) else kinds
        self.confidence = np.full(n, confidence) if isinstance(confidence, float) else np.asarray(confidence, np.float64)
        self.box = scaled(box, scale, least)

    def take(self, kept: np.ndarray) -> Hits:
        out = object.__new__(Hits)
        out.stage, out.reason, out.scan, out.box, out.confidence = self.stage, self.reason, self.scan[kept], self.box[kept], self.confidence[kept]
        out.kinds, out.values = ([v[i] for i in kept.tolist()] for v in (self.kinds, self.values))
        return out

    def table(self, ids: pa.Array) -> pa.Table:
        n, box = len(self.values), self.box.astype(np.int32)
        columns = [[self.stage] * n, self.kinds, self.values, [self.reason] * n, *(box[:, k] for k in range(4)), self.confidence]
        return pa.Table.from_arrays([ids.take(pa.array(self.scan)), *(pa.array(c, k) for c, k in zip(columns, KINDS))], ["scan_id", *(x.split()[0] for x in SCHEMA.split(", "))])


def together(own: Hits, others: list[Hits]) -> tuple[np.ndarray, np.ndarray]:
    """Boxes of the others and the own ones, those of different scans far from each other, and which are own."""
    box = np.concatenate([*(o.box for o in others), own.box])
    scan = np.concatenate([*(o.scan for o in others), own.scan])
    if len(box):
        far = (box[:, 0] + box[:, 2]).max() - box[:, 0].min() + 4 * W.CELL
        box[:, 0] += scan * far
    return box, np.arange(len(box)) >= len(box) - len(own.box)


def apart(own: Hits, others: list[Hits], px: int) -> Hits:
    if not len(own.scan):
        return own
    box, mine = together(own, others)
    kept = W.apart(box[:, 0], box[:, 1], mine, px)
    return own.take(np.sort(np.array(kept, np.int64)) - (len(box) - len(own.box)))


def like_others(scan: np.ndarray, box: np.ndarray, others: list[Hits]) -> np.ndarray:
    """Which boxes are the same as one of the others in their scan."""
    rows = np.concatenate([*(np.column_stack([o.scan, o.box]) for o in others), np.column_stack([scan, box])])
    mine = np.arange(len(rows)) >= len(rows) - len(box)
    order = np.lexsort((mine, *rows.T))
    new = np.concatenate([[True], (np.diff(rows[order], axis=0) != 0).any(1)])[: len(rows)]
    out = np.zeros(len(rows), bool)
    out[order] = ~mine[order][new][np.cumsum(new) - 1]
    return out[mine]


def uncovered(own: Hits, others: list[Hits]) -> Hits:
    """The own boxes whose IoU with none of the others, nor with a kept one before, is above a half."""
    if not len(own.scan):
        return own
    box, mine = together(own, others)
    x, y, w, h = box.T
    # the others that may stand in the cell of an own middle, and aren't twice as large as all own boxes
    cell = lambda x, y: np.floor(x / W.CELL).astype(np.int64) << 24 | np.floor(y / W.CELL).astype(np.int64)
    wanted, near = np.unique(cell((x + w / 2)[mine], (y + h / 2)[mine])), (w > W.CELL) | (h > W.CELL)
    for a, b in ((x, y), (x + w, y), (x, y + h), (x + w, y + h)):
        near |= np.isin(cell(a, b), wanted)
    at = np.flatnonzero(mine | near & (w * h < 2 * (w * h)[mine].max()))
    kept = at[W.uncovered_of(dict(zip("xywh", box[at].T)), mine[at])]
    return own.take(kept - (len(box) - len(own.box)))


def around(words: Words, first: np.ndarray) -> np.ndarray:
    """The least boxes around words from each of the first ones up to the next."""
    x, y = (np.minimum.reduceat(a, first) for a in (words.x, words.y))
    return np.stack([x, y, np.maximum.reduceat(words.x + words.w, first) - x, np.maximum.reduceat(words.y + words.h, first) - y], 1)


def line_hits(words: Words, sought: Sought, first: np.ndarray, scale: tuple[float, float], px: int = 10) -> Hits:
    """Hits of whole lines, boxed by the words that they touch. first: where lines begin, and the end."""
    lines = [np.unique(np.searchsorted(first, at, "right") - 1) for at in sought.places]
    rows, boxes = [], []
    for line, ranks in sorted(ranks_of(lines).items()):
        low, high = int(first[line]), int(first[line + 1]) - 1
        for f in sought.hits(low, high, ranks):
            start = sought.starts[low] + f[3]
            a, z = np.searchsorted(sought.ends, start, "right"), np.searchsorted(sought.starts, start + len(f[2]), "left")
            rows.append((words.scan[low], f[1].kind, sought.value(low, f)))
            x, y = words.x[a:z].min(), words.y[a:z].min()
            boxes.append((x, y, (words.x[a:z] + words.w[a:z]).max() - x, (words.y[a:z] + words.h[a:z]).max() - y))
    return apart(Hits("line", "ocr_pii_match", [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], boxes, scale, (8, 8), 0.85), [], px)


def word_hits(words: Words, sought: Sought, others: list[Hits], scale: tuple[float, float], px: int = 10) -> Hits:
    """Hits of single words."""
    rows = [(i, f[1].kind, sought.value(i, f)) for i, ranks in sorted(ranks_of(sought.places).items()) for f in sought.hits(i, i, ranks)]
    at = np.array([r[0] for r in rows], np.int64)
    # a scan's words in the order of their places
    order = np.lexsort((words.ord[at], words.scan[at]))
    at, rows = at[order], [rows[i] for i in order.tolist()]
    box = np.stack([a[at] for a in (words.x, words.y, words.w, words.h)], 1)
    return apart(Hits("word", "ocr_pii_match", words.scan[at], [r[1] for r in rows], [r[2] for r in rows], box, scale, (8, 8), np.floor(words.sure[at] + 0.5) / 100), others, px)


def window_hits(words: Words, forms: list[Sought], others: list[Hits], scale: tuple[float, float], px: int = 15) -> Hits:
    """Hits of runs of 2 to 5 words on one line, shorter runs first, as they are and with letters read as digits. Of runs with one corner the
    first that has a hit tells: what follows is near it, or near what it is near."""
    n, by_form = len(words.texts), [ranks_of(s.places) for s in forms]
    at = np.array(sorted({i for f in by_form for i in f}), np.int64)
    left, top, right, bottom, total = words.x.copy(), words.y.copy(), words.x + words.w, words.y + words.h, words.h.copy()
    rows, boxes, seen = [], [], set()
    for size in range(2, W.LONGEST + 1):
        m = max(n - size + 1, 0)
        left, top = np.minimum(left[:m], words.x[n - m :]), np.minimum(top[:m], words.y[n - m :])
        right, bottom = np.maximum(right[:m], (words.x + words.w)[n - m :]), np.maximum(bottom[:m], (words.y + words.h)[n - m :])
        total = total[:m] + words.h[n - m :]
        first = np.unique((at[:, None] - np.arange(size)).ravel())
        first = first[(first >= 0) & (first < m)]
        first = first[(words.scan[first] == words.scan[first + size - 1]) & (bottom[first] - top[first] <= total[first] / size * W.SPREAD)]
        for i, corner in zip(first.tolist(), zip(words.scan[first].tolist(), left[first].tolist(), top[first].tolist())):
            if corner in seen:
                continue
            last = i + size - 1
            for form, (sought, ranks) in enumerate(zip(forms, by_form)):
                own = {r for k in range(i, last + 1) if k in ranks for r in ranks[k]}
                if not own or form and sought.raw[sought.starts[i] : sought.ends[last]] == forms[0].raw[sought.starts[i] : sought.ends[last]]:
                    continue
                if found := sought.hits(i, last, sorted(own)):
                    seen.add(corner)
                    rows.append((corner[0], found[0][1].kind, sought.value(i, found[0])))
                    boxes.append((left[i], top[i], right[i] - left[i], bottom[i] - top[i]))
                    break
    return apart(Hits("window", "ocr_multiword_pii", [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], boxes, scale, (12, 12), 0.92), others, px)


@lru_cache(maxsize=16)
def regex_of(pattern: str) -> re.Pattern:
    """As Java reads it: before the end a line's end may stand."""
    java = P.java(pattern, True)
    return re.compile(java[:-1] + r"(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z" if java.endswith("$") else java, re.ASCII)


def no_headers(values: list[str], pattern: str, text: str) -> list[int]:
    """Which words of the text have two letters or more and are no headers. In a plain list of headers they are looked up first."""
    header, plain = regex_of(pattern), re.fullmatch(r"\^\(([a-z|]+)\)\$", pattern)
    if not plain or any(end in text for end in "\n\r\u0085  "):
        return [k for k, v in enumerate(values) if len(v) > 1 and not header.search(v)]
    listed = frozenset(plain[1].split("|"))
    return [k for k, (v, low) in enumerate(zip(values, map(str.lower, values))) if len(v) > 1 and not (low in listed and header.search(v))]


def guard_hits(words: Words, sought: Sought, first: np.ndarray, hits: list[Hits], guard: str, scale: tuple[float, float]) -> list[Hits]:
    """What a guard of operators.words covers in the scans that are marked."""
    g, text, starts, ends = W.GUARDS[guard], sought.raw, sought.starts, sought.ends
    marked = {int(s) for h in hits for s, k in zip(h.scan, h.kinds) if k in g["kinds"]}
    low = sought.flat.tobytes().lower()
    places = np.array([i for part in g["mark_words"] for i in finds(low, part.encode())], np.int64)
    for line in np.unique(np.searchsorted(ends[first[1:] - 1], places, "right")).tolist():
        if regex_of(g["marks"]).search(text[starts[first[line]] : ends[first[line + 1] - 1]]):
            marked.add(int(words.scan[first[line]]))
    if not marked:
        return []
    own, out = np.isin(words.scan, list(marked)), []
    if g["reasons"][0]:
        lines = np.flatnonzero(own[first[:-1]])
        values = [text[a:z].strip(" ") for a, z in zip(starts[first[lines]].tolist(), ends[first[lines + 1] - 1].tolist())]
        good = [k for k, v in enumerate(values) if v and not regex_of(g["line_headers"]).search(v)]
        lines, values = lines[good], [values[k] for k in good]
        out.append(apart(Hits(f"{guard} line", g["reasons"][0], words.scan[first[lines]], g["kind"], values, around(words, first[:-1])[lines], scale, (g["least_width"][0], 12), 0.95), hits, 15))
    at = np.flatnonzero(own)
    at = at[np.lexsort((words.ord[at], words.scan[at]))]
    boxes = lambda at: np.stack([a[at] for a in (words.x, words.y, words.w, words.h)], 1)
    least = (g["least_width"][1], 12)
    if not g["reasons"][0]:  # most may have been covered by a guard before
        at = at[~like_others(words.scan[at], scaled(boxes(at), scale, least), hits)]
    values = [words.texts[i].strip(" ") for i in at.tolist()]
    good = no_headers(values, g["word_headers"], text)
    at, values = at[good], [values[k] for k in good]
    found = Hits(f"{guard} word", g["reasons"][1], words.scan[at], g["kind"], values, boxes(at), scale, least, 0.95)
    return [*out, apart(found, [*hits, *out], 10) if g["reasons"][0] else uncovered(found, [*hits, *out])]


def sought_in(words: Words, patterns: tuple[P.Pattern, ...], forms: int) -> list[Sought]:
    """For each form of the words."""
    raw = " ".join(words.texts) + " "
    ends = np.cumsum(np.fromiter(map(len, words.texts), np.int64, len(words.texts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [Sought(t, starts, ends, patterns) for t in [raw, as_digits(raw)][:forms]]


def all_stages(words: Words, patterns: tuple[P.Pattern, ...], scale: tuple[float, float], guards: tuple[str, ...]) -> list[Hits]:
    """As scan_words() of operators.words."""
    by_ord = words.sorted("scan", "ord")
    forms = sought_in(words, patterns, 2 if by_ord is words else 1)
    first = np.concatenate([[0], np.flatnonzero((np.diff(words.scan) != 0) | (np.diff(words.line) != 0)) + 1, [len(words.texts)]])
    hits = [line_hits(words, forms[0], first, scale)]
    hits.append(word_hits(words, forms[0], hits, scale))
    hits.append(window_hits(by_ord, forms if by_ord is words else sought_in(by_ord, patterns, 2), hits, scale))
    for guard in guards:
        hits += guard_hits(words, forms[0], first, hits, guard, scale)
    return hits


def windows_alone(words: Words, patterns: tuple[P.Pattern, ...], scale: tuple[float, float], guards: tuple[str, ...]) -> list[Hits]:
    by_ord = words.sorted("scan", "ord")
    return [window_hits(by_ord, sought_in(by_ord, patterns, 2), [], scale)]


# --- operators ---
def _in_rows(rows: DataFrame, read: Callable[[pa.Table], Words], work: Callable, patterns: list[P.Pattern], scale: tuple[float, float], guards: tuple[str, ...]) -> DataFrame:
    ship(rows.sparkSession)
    rows = spread(rows.filter("scan_id IS NOT NULL"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in stretches(batches):
            words = read(t)
            if len(words.texts):
                ids = t["scan_id"].combine_chunks()
                found = [hits.table(ids) for hits in work(words, tuple(patterns), scale, guards)]
                yield from pa.concat_tables(found).combine_chunks().to_batches(8192)

    return rows.mapInArrow(each, f"scan_id {rows.schema['scan_id'].dataType.simpleString()}, {SCHEMA}")


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of about STRETCH bytes together."""
    held, n = [], 0
    for b in batches:
        t = pa.Table.from_batches([b])
        step = max(1, min(len(t), STRETCH * len(t) // max(t.nbytes, 1)))
        for at in range(0, len(t), step):
            held.append(t.slice(at, step))
            n += held[-1].nbytes
            if n >= STRETCH:
                yield pa.concat_tables(held)
                held, n = [], 0
    if held:
        yield pa.concat_tables(held)


def scan_whole(rows: DataFrame, read: Callable[[pa.Table], Words] = of_words, patterns: list[P.Pattern] = P.SCREEN, scale: tuple[float, float] = (1.0, 1.0), guards: tuple[str, ...] = tuple(W.GUARDS)) -> DataFrame:
    """All stages, as scan_words() of operators.words, of rows that are a whole scan each (scan_id, and what read makes words of); null ids are left out."""
    return _in_rows(rows, read, all_stages, patterns, scale, guards)


def scan_whole_windows(rows: DataFrame, read: Callable[[pa.Table], Words] = of_words, patterns: list[P.Pattern] = P.SCREEN, scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Hits of runs of words, as scan_word_windows() of operators.words without existing hits, of rows that are a whole scan each."""
    return _in_rows(rows, read, windows_alone, patterns, scale, ())
