"""Hits of the patterns in texts, found inside tasks: where a hit may start is told by a quick pattern, the pattern itself is tried there alone.

Quick patterns begin with a class of characters and only look ahead, so that a text is passed over at the speed of a search for
characters. They name every place where a hit can start; what is found is what a search through the whole text finds."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskline.functions import patterns as P

FINDING = "struct<rank:int,kind:string,token:string,category:string,value:string,start:int,length:int>"
TYPE = pa.list_(pa.struct([("rank", pa.int32()), ("kind", pa.string()), ("token", pa.string()), ("category", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

W = f"[{P.WHITE}]"
WD = f"[{P.WHITE}-]"
#: Where hits of a regex may start: a class of first characters, then what must follow (fixed values). For others the whole text is searched.
STARTS = {
    P.CARD: r"[0-9](?=[0-9]{3}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4})",
    P.AADHAAR: rf"[1-9](?=[0-9]{{3}}{WD}{{0,2}}[0-9]{{4}}{WD}{{0,2}}[0-9]{{4}})",
    P.VID: rf"[0-9](?=[0-9]{{3}}{WD}{{0,2}}[0-9]{{4}}{WD}{{0,2}}[0-9]{{4}}{WD}{{0,2}}[0-9]{{4}})",
    P.SSN: rf"[0-9](?=[0-9]{{2}}{WD}?[0-9]{{2}}{WD}?[0-9]{{4}})",
    P.PHONE: rf"[+0-9](?=[0-9{P.WHITE}\-().]{{8}})",
    P.PAN: "[A-Z](?=[A-Z]{4}[0-9]{4}[A-Z])",
    P.PASSPORT: "[A-Z](?=[0-9]{7})",
    P.IFSC: "[A-Z](?=[A-Z]{3}0[A-Z0-9]{6})",
    P.GSTIN: "[0-9](?=[0-9][A-Z]{5}[0-9]{4}[A-Z])",
    P.LICENCE: rf"[A-Z](?=[A-Z][-{P.WHITE}]?[0-9]{{2}}[-{P.WHITE}]?[0-9]{{4}})",
    P.VEHICLE: rf"[A-Z](?=[A-Z]{WD}?[0-9]{{1,2}}{WD}?[A-Z]{{1,3}}{WD}?[0-9]{{4}})",
    P.ACCOUNT: "[aAbB](?=(?i:/c|cc|ank))",
    P.EMPLOYEE: "[inedbsINEDBS](?<![A-Za-z0-9_].)(?=(?i:sro|asa|sa|rdo|arc|mp|taff|d)" + rf"{WD}?[0-9]{{4}})",
    P.ROLE_NAME: "[hadlomesHADLOMES](?<![A-Za-z0-9_].)(?=(?i:r|dmin|ead|irector|fficer|anager|mployee|taff)" + rf"{W}*[—–-])",
    r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b": "[+(0-9](?=(?:[^0-9]{0,2}[0-9]){9})",
    # to the number's end, giving nothing back: the regex itself tries every way to part a run of white space
    r"\b(?:cvv|cvc|security_code)\s*[:=]?\s*(\d{3,4})\b": rf"[cCsS](?=(?i:v[vc]|ecurity_code){W}*+[:=]?+{W}*+[0-9]{{3,4}}+(?![A-Za-z0-9_]))",
    r"\b([A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}(?:[A-Z0-9]?){0,16})\b": "[A-Z](?=[A-Z][0-9]{2}[A-Z0-9]{4}[0-9]{7})",
    r"\b([A-Z]{3}[0-9]{7})\b": "[A-Z](?=[A-Z]{2}[0-9]{7})",
    r"\b([A-Z]{2}[0-9]{2}[0-9]{11})\b": "[A-Z](?=[A-Z][0-9]{13})",
    r"\b[A-HJ-NPR-Z0-9]{17}\b": "[A-HJ-NPR-Z0-9](?=[A-HJ-NPR-Z0-9]{16})",
    r"\b(male|female|transgender|पुरुष|महिला)\b": "[mftMFTपम](?=(?i:ale|emale|ransgender|ुरुष|हिला))",
    P.NAME_WITH_ID: rf"[A-Z](?=[a-z]+{W})",
}
#: Regexes whose hits have a digit among their first BEFORE + 1 characters; STARTS look no further than AFTER characters.
BEFORE, AFTER = 8, 32
DIGITS_EARLY = {P.CARD, P.AADHAAR, P.VID, P.SSN, P.PHONE, P.PAN, P.PASSPORT, P.IFSC, P.GSTIN, P.LICENCE, P.VEHICLE, P.EMPLOYEE, *(p.regex for p in P.PERSONAL if p.kind in ("iban", "voter_id", "driving_license", "phone"))}
#: Characters as bytes, one for each: digits become "0", others blanks.
DIGITS = bytes(48 if 48 <= i < 58 else 32 for i in range(256))
ASSIGNED, DASHES = (":", "="), ("-", "–", "—")
NEEDED = {
    "cvv": [("cvv", "cvc", "security_code")], "aws_secret_key": [ASSIGNED, ("secret_key", "secret_access_key")], "aws_session_token": [ASSIGNED, ("session_token", "security_token")],
    "password_field": [ASSIGNED, ("password", "passwd", "client_secret")], "generic_api_key": [ASSIGNED, ("key", "token", "secret")],
}
#: Of each row of words and marks one stands in every hit of the regex, letters in either case: other texts aren't searched at all.
NEEDS = {p.regex: NEEDED[p.kind] for p in P.SECRETS + P.PERSONAL if p.kind in NEEDED} | {
    P.ACCOUNT: [tuple("0123456789"), ("a/c", "acct", "account", "bank")], P.NAME_WITH_ID: [DASHES, tuple("0123456789")],
    P.ROLE_NAME: [DASHES, ("hr", "admin", "lead", "director", "officer", "manager", "employee", "staff")],
}
#: Addresses have one "@", with these characters before it, and from it on what stands here: whether that fits doesn't depend on where the hit begins.
AT_BEFORE = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
EMAIL_END, UPI_END = (x[x.index("@") :] for x in (P.EMAIL, P.UPI))
AT_REGEXES = {P.EMAIL: EMAIL_END, rf"\b({P.EMAIL})\b": rf"{EMAIL_END}\b", P.UPI: UPI_END}
LABELS = re.compile(r"\\b\(" + re.escape(P.VALUE_LABEL))


def label_starts() -> str:
    """Where a label of a value may start: its first letter, and what follows it."""
    rest: dict[str, list[str]] = {}
    for x in P.VALUE_LABEL.split("|"):
        rest.setdefault(x[0], []).append(re.match("[a-z/]*", x[1:])[0])
    firsts = "".join(rest) + "".join(rest).upper()
    return f"[{firsts}](?<![A-Za-z0-9_].)(?=(?i:{'|'.join(dict.fromkeys(y for ys in rest.values() for y in ys))}))"


def around_at(text: str, regex: re.Pattern, end: re.Pattern) -> list[re.Match]:
    """Hits by their "@": the regex is tried only before one that the rest of a hit follows, else it reads a long run again from every place in it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        if end.match(text, at):
            low = at
            while low > done and text[low - 1] in AT_BEFORE:
                low -= 1
            if m := next(filter(None, (regex.match(text, i) for i in range(low, at))), None):
                out.append(m)
                done = m.end()
        at = text.find("@", at + 1)
    return out


def at_starts(text: str, regex: re.Pattern, quick: re.Pattern) -> list[re.Match]:
    out, done = [], 0
    for q in quick.finditer(text):
        at = q.start()
        if at >= done and (m := regex.match(text, at)):
            out.append(m)
            done = m.end()
    return out


@lru_cache(maxsize=1)  # one text is searched for many patterns in turn
def near_digits(text: str) -> list[tuple[int, int]]:
    """Parts of a text, apart from each other, that hold all its digits and what stands BEFORE and AFTER them."""
    flat, gap, out = text.encode("latin-1", "replace").translate(DIGITS), BEFORE + AFTER + 1, []
    first = flat.find(b"0")
    while first >= 0:
        last = first
        while (more := flat.rfind(b"0", last + 1, last + 1 + gap)) >= 0:
            last = more
        out.append((max(0, first - BEFORE), min(len(text), last + 1 + AFTER)))
        first = flat.find(b"0", last + 1 + gap)
    return out


def digit_starts(text: str, regex: re.Pattern, quick: re.Pattern) -> list[re.Match]:
    """at_starts() for hits that begin near a digit: the rest of the text is passed over."""
    out, done = [], 0
    for low, high in near_digits(text):
        for q in quick.finditer(text, low, high):
            at = q.start()
            if at >= done and (m := regex.match(text, at)):
                out.append(m)
                done = m.end()
    return out


@lru_cache(maxsize=1)
def lowered(text: str) -> str:
    return text.lower()


@lru_cache(maxsize=256)
def searcher(regex: str, ignore_case: bool, hint: str | None = None) -> Callable[[str], list[re.Match]]:
    """A function that gives all hits of a pattern in a text, from left to right, none inside another."""
    search, needs = search_of(regex, ignore_case, hint), NEEDS.get(regex)
    return (lambda t: search(t) if all(any(x in lowered(t) for x in row) for row in needs) else []) if needs else search


def search_of(regex: str, ignore_case: bool, hint: str | None) -> Callable[[str], list[re.Match]]:
    full = re.compile(P.java(regex, ignore_case), re.ASCII)
    if regex in AT_REGEXES:
        end = re.compile(P.java(AT_REGEXES[regex], ignore_case), re.ASCII)
        return lambda t: around_at(t, full, end)
    quick = label_starts() if LABELS.match(regex) else STARTS.get(regex)
    if quick:
        first = re.compile(quick, re.ASCII)
        if regex in DIGITS_EARLY:
            return lambda t: digit_starts(t, full, first)
        return lambda t: at_starts(t, full, first)
    if hint is None:
        return lambda t: list(full.finditer(t))
    plain = re.compile(r"[A-Za-z0-9 :/_@-]+")
    if plain.fullmatch(hint):  # a text is passed over by looking for the characters themselves
        return lambda t: list(full.finditer(t)) if hint in t else []
    quick_hint = re.compile(hint, re.ASCII)
    return lambda t: list(full.finditer(t)) if quick_hint.search(t) else []


#: A pair of label and value starts at the text's start or a part's, and its label runs up to the mark between them.
PAIR, PAIR_LEAD = re.compile(P.java(P.KEY_VALUE), re.ASCII), rf"[a-zA-Z0-9{P.WHITE}._\-#]++[:=–—]"
FIRST_PAIR, LATER_PAIRS = re.compile(PAIR_LEAD), re.compile(rf"[|\n\r;](?={PAIR_LEAD})")


def pairs_of(text: str | None) -> list[dict]:
    """label, value, start (of the value) of all `label: value` pairs, from left to right."""
    if not text:
        return []
    if "\x01" in text or "\x02" in text:
        text = text.translate(MARKS)
    first = PAIR.match(text) if FIRST_PAIR.match(text) else None
    hits, done = [first] if first else [], first.end() if first else 0
    for q in LATER_PAIRS.finditer(text, done):
        if q.start() >= done and (m := PAIR.match(text, q.start())):
            hits.append(m)
            done = m.end()
    # a value stands where its text first stands in the hit
    return [{"label": m[1], "value": m[2], "start": m.start() + m[0].find(m[2])} for m in hits]


def pairs(text: Column) -> Column:
    kind = pa.list_(pa.struct([("label", pa.string()), ("value", pa.string()), ("start", pa.int32())]))

    def each(texts: pa.Array) -> pa.Array:
        return pa.array([pairs_of(t) for t in texts.to_pylist()], kind)

    each.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, "array<struct<label:string,value:string,start:int>>")(text)


OTHER_DIGITS = {ord(b) + i: str(i) for b in P.DIGIT_BLOCKS for i in range(10)}
HAS_OTHER = re.compile("[" + "".join(f"{b}-{chr(ord(b) + 9)}" for b in P.DIGIT_BLOCKS) + "]")


def normalized(text: str) -> str:
    """normalize_digits of the scalar functions."""
    return text if text.isascii() or not HAS_OTHER.search(text) else text.translate(OTHER_DIGITS)


#: Control characters of the SQL's own marks; in a value they count as another.
MARKS = {1: "\u0003", 2: "\u0003"}


def findings(text: str | None, patterns: list[P.Pattern], least: int, normalize: bool = False) -> list[tuple]:
    """rank, pattern, value, start of all hits of a text, as places() of the operators has them."""
    if not text:
        return []
    if normalize:
        text = normalized(text)
    if "\x01" in text or "\x02" in text:
        text = text.translate(MARKS)
    out = []
    for rank, p in enumerate(patterns):
        for m in searcher(p.regex, p.ignore_case, p.hint)(text):
            value = m[p.group]
            if len(value) >= least:
                # a value stands where its text first stands in the hit
                out.append((rank, p, value, m.start() + (m[0].find(value) if p.group else 0)))
    return out


def packed(rows: list[list[tuple]]) -> pa.Array:
    """Lists of findings as one array of TYPE."""
    offsets, flat = [0], []
    for r in rows:
        flat += r
        offsets.append(len(flat))
    names = [f.name for f in TYPE.value_type]
    columns = [[x[0] for x in flat], [x[1].kind for x in flat], [x[1].token for x in flat], [x[1].category for x in flat], [x[2] for x in flat], [x[3] for x in flat], [len(x[2]) for x in flat]]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, TYPE.value_type[i].type) for i, c in enumerate(columns)], names))


#: What marks a value's end for Java's "$": a line's end may follow.
ENDS_SENTENCE = re.compile(r"[.?!](?:\r\n|[\n\r\u0085\u2028\u2029])?\Z")
NO_VALUE = re.compile(P.java(P.NOT_A_VALUE, True), re.ASCII)
LETTER, DIGIT, SPACES = re.compile("[a-zA-Z]"), re.compile("[0-9]"), re.compile(f"{W}+")


def looks_right(f: tuple) -> bool:
    """Whether a phone, card or labelled value is one, not only its shape."""
    kind, value = f[1].kind, f[2]
    if kind in ("phone", "card"):
        return not ("." in value or LETTER.search(value)) and len(DIGIT.findall(value)) >= (9 if kind == "phone" else 13)
    if kind == "labelled_value":
        trimmed = value.strip(" ")
        return not (len(SPACES.split(trimmed)) > 4 or ENDS_SENTENCE.search(trimmed) or NO_VALUE.search(trimmed))
    return True


def long_secrets(f: tuple) -> bool:
    """Credentials count from 8 characters on."""
    return f[1].category != "secret" or len(f[2]) >= 8


def unclaimed(found: list[tuple]) -> list[tuple]:
    """Findings, in order, less those that overlap an earlier one. What is kept lies apart, so only its neighbours may overlap."""
    out, starts, ends = [], [], []
    for f in found:
        start, end = f[3], f[3] + len(f[2])
        at = bisect_right(starts, start)
        if (at == 0 or ends[at - 1] <= start) and (at == len(starts) or starts[at] >= end):
            out.append(f), starts.insert(at, start), ends.insert(at, end)
    return out


def chosen(text: str | None, patterns: list[P.Pattern], least: int, normalize: bool = False, keep: Callable[[tuple], bool] | None = None, claims: bool = False) -> list[tuple]:
    rows = findings(text, patterns, least, normalize)
    rows = [f for f in rows if keep(f)] if keep else rows
    return unclaimed(rows) if claims else rows


@lru_cache(maxsize=256)
def start_of(regex: str, hint: str) -> re.Pattern:
    """What every text with a hit of the pattern fits, somewhere."""
    if regex in AT_REGEXES:
        return re.compile("@")
    return re.compile(label_starts() if LABELS.match(regex) else STARTS.get(regex, hint), re.ASCII)


def chosen_of_many(texts: list[str | None], patterns: list[P.Pattern], least: int, normalize: bool, keep: Callable[[tuple], bool] | None, claims: bool) -> list[list[tuple]]:
    """chosen() of short texts: they are passed over as one, and a pattern is tried on those alone where a hit may start."""
    texts = [(normalized(t) if normalize else t).translate(MARKS) if t else "" for t in texts]
    whole, ends = "\0".join(texts), list(accumulate(len(t) + 1 for t in texts))
    out: list[list[tuple]] = [[] for _ in texts]
    for rank, p in enumerate(patterns):
        last = -1
        for q in start_of(p.regex, p.hint).finditer(whole):
            k = bisect_right(ends, q.start())
            if k == last:
                continue
            last = k
            for m in searcher(p.regex, p.ignore_case, p.hint)(texts[k]):
                if len(value := m[p.group]) >= least:
                    out[k].append((rank, p, value, m.start() + (m[0].find(value) if p.group else 0)))
    out = [[f for f in r if keep(f)] if keep and r else r for r in out]
    return [unclaimed(r) if r else r for r in out] if claims else out


#: Texts of so many characters on average are passed over together.
SHORT = 200
#: Findings of so many short texts are kept in a worker process, for those that come up again, as words do.
KEPT = 100_000
_kept: dict[tuple, dict[str, list[tuple]]] = {}


def remembered(texts: list[str | None], patterns: list[P.Pattern], least: int, normalize: bool, keep: Callable[[tuple], bool] | None, claims: bool) -> list[list[tuple]]:
    """chosen_of_many(), each different text looked at once, and not again while it is kept."""
    if len(_kept) > 8:
        _kept.clear()
    own = _kept.setdefault((tuple(patterns), least, normalize, keep, claims), {})
    if len(own) > KEPT:
        own.clear()
    new = [t for t in dict.fromkeys(texts) if t not in own]
    own.update(zip(new, chosen_of_many(new, patterns, least, normalize, keep, claims)))
    return [own[t] for t in texts]


def found(text: Column, patterns: list[P.Pattern], least: int, normalize: bool = False, keep: Callable[[tuple], bool] | None = None, claims: bool = False) -> Column:
    """All findings of a text, by pattern and place, that keep names; claims: less those that overlap an earlier one. Null: none."""

    def scan(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        if sum(len(t) for t in rows if t) < SHORT * len(rows):
            return packed(remembered(rows, patterns, least, normalize, keep, claims))
        return packed([chosen(t, patterns, least, normalize, keep, claims) for t in rows])

    scan.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(scan, f"array<{FINDING}>")(text)


SCRUBBED = "struct<clean_text:string,n_secrets:int,n_pii:int,tokens:array<struct<token:string,value:string>>>"


def scrubbed(text: str | None, patterns: list[P.Pattern]) -> dict:
    """A text with its values replaced, longer ones first; how many were found; and the token of each different value, by its first place."""
    rows = chosen(text, patterns, 3, keep=long_secrets, claims=True)
    numbers, tokens = Counter(), {}
    for f in rows:
        if (f[1].token, f[2]) not in tokens:
            numbers[f[1].token] += 1
            tokens[f[1].token, f[2]] = f"[{f[1].token}_{numbers[f[1].token]}]"
    secrets = sum(f[1].category == "secret" for f in rows)
    pairs = [{"token": token, "value": value} for (_, value), token in tokens.items()]
    for p in sorted(pairs, key=lambda p: (-len(p["value"]), p["token"], p["value"])):
        text = text.replace(p["value"], p["token"])
    return {"clean_text": text, "n_secrets": secrets, "n_pii": len(rows) - secrets, "tokens": pairs}


def scrub(text: Column, patterns: list[P.Pattern]) -> Column:
    kind = pa.struct([("clean_text", pa.string()), ("n_secrets", pa.int32()), ("n_pii", pa.int32()), ("tokens", pa.list_(pa.struct([("token", pa.string()), ("value", pa.string())])))])

    def each(texts: pa.Array) -> pa.Array:
        return pa.array([scrubbed(t, patterns) for t in texts.to_pylist()], kind)

    each.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, SCRUBBED)(text)


def hits_any(text: str | None, folded: list[P.Pattern], plain: list[P.Pattern]) -> bool:
    if not text:
        return False
    digits = normalized(text)
    return any(searcher(p.regex, p.ignore_case)(digits) for p in folded) or any(searcher(p.regex, p.ignore_case)(text) for p in plain)


def any_hit(text: Column, folded: list[P.Pattern], plain: list[P.Pattern]) -> Column:
    """Whether a text holds a hit of one of the patterns: of the first ones with its digits normalized. Null: false."""

    def each(texts: pa.Array) -> pa.Array:
        return pa.array([hits_any(t, folded, plain) for t in texts.to_pylist()], pa.bool_())

    each.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, "boolean")(text)
