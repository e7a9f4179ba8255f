"""The scalar functions that the jobs share, as column expressions; register() gives them to SQL."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import patterns as P

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digits(c: ColumnLike) -> Column:
    return F.regexp_replace(col(c), "[^0-9]", "")


def flat(table: list[list[int]]) -> str:
    """The digits of a table, row after row."""
    return "".join(str(x) for row in table for x in row)


def luhn_valid(c: ColumnLike) -> Column:
    """Whether the 13 to 19 digits of a text meet the Luhn checksum. Null: null."""
    d = F.reverse(digits(c))
    n = F.length(d)

    def at(i: Column) -> Column:
        x = F.substr(d, i, F.lit(1)).cast("int")
        twice = 2 * x
        return F.when(i % 2 == 1, x).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), at), F.lit(0), lambda a, x: a + x)
    return n.between(13, 19) & (total % 10 == 0)


def verhoeff_valid(c: ColumnLike) -> Column:
    """Whether the digits of a text (two at least) meet the Verhoeff checksum."""
    d = F.reverse(digits(c))
    n = F.length(d)
    table, perm = F.lit(flat(P.VERHOEFF_D)), F.lit(flat(P.VERHOEFF_P))

    def step(a: Column, i: Column) -> Column:
        x = F.substr(d, i + 1, F.lit(1)).cast("int")
        p = F.substr(perm, (i % 8) * 10 + x + 1, F.lit(1)).cast("int")
        return F.substr(table, a * 10 + p + 1, F.lit(1)).cast("int")

    return (n >= 2) & (F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), step) == 0)


def normalize_digits(c: ColumnLike) -> Column:
    """Ten blocks of digits as ASCII ones; the length stays."""
    source = "".join(chr(ord(b) + i) for b in P.DIGIT_BLOCKS for i in range(10))
    return F.translate(col(c), source, "0123456789" * len(P.DIGIT_BLOCKS))


def fold_ocr_digits(c: ColumnLike) -> Column:
    """Letters that scanners read for digits, as digits."""
    return F.translate(col(c), "".join(P.OCR_DIGITS), "".join(P.OCR_DIGITS.values()))


def keyword_form(c: ColumnLike) -> Column:
    """camelCase and snake_case as lower-case words."""
    x = F.regexp_replace(col(c), "([a-z0-9])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, "[_\\-.]+", " "), f"[{P.WHITE}]+", " ")))


#: What a caption begins with: others need no normalizing.
_BLANK = f"[\\u200B-\\u200D\\uFEFF\\u200E\\u200F\\u00A0\\u202A-\\u202E•·|—–{P.WHITE}-]"
CAPTION_START = rf"(?iu)\A{_BLANK}*(?:{'|'.join(dict.fromkeys(x.split()[0] for x in P.CHROME))}|\d+{_BLANK}+unread)"


def is_app_chrome(c: ColumnLike) -> Column:
    """Whether a text is a caption of the application itself. Null: false."""
    x = F.regexp_replace(col(c), "[\\u200B-\\u200D\\uFEFF\\u200E\\u200F\\u00A0\\u202A-\\u202E]", " ")
    x = F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, "[•·|—–-]+", " "), f"[{P.WHITE}]+", " ")))
    return F.coalesce(F.when(col(c).rlike(CAPTION_START), x.isin(P.CHROME) | x.rlike(r"^\d+ unread(?: messages?)?$") | x.startswith("not a contact")), F.lit(False))


def overlap_area(a: Column, b: Column) -> Column:
    """Shared area of two boxes: structs with x, y, w, h."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Shared area over the area of the union; 0 for boxes without area."""
    shared = overlap_area(a, b)
    union = a["w"] * a["h"] + b["w"] * b["h"] - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def coverage(truth: Column, box: Column) -> Column:
    """Share of the first box's area that the second covers."""
    area = truth["w"] * truth["h"]
    return F.when(area > 0, overlap_area(truth, box) / area).otherwise(F.lit(0.0))


def text_similarity(target: ColumnLike, element: ColumnLike) -> Column:
    """1 where the element's text holds the target's, 0.8 where the target holds it (over 3 characters), else the share of
    the target's words of over two letters that stand in it; 0 without words. Null or empty: 0."""
    t, e = F.lower(F.trim(col(target))), F.lower(F.trim(col(element)))
    words = F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 2)
    share = F.coalesce(F.size(F.filter(words, lambda w: F.contains(e, w))) / F.nullif(F.size(words), F.lit(0)), F.lit(0.0))
    empty = (F.coalesce(F.length(col(target)), F.lit(0)) == 0) | (F.coalesce(F.length(col(element)), F.lit(0)) == 0)
    return F.when(empty, 0.0).when(F.contains(e, t), 1.0).when(F.contains(t, e) & (F.length(e) > 3), 0.8).otherwise(share)


def parse_price(c: ColumnLike) -> Column:
    """The first number of a text, thousands' commas dropped; null if there is none."""
    return F.regexp_replace(F.regexp_extract(col(c), r"(\d[\d,]*(?:\.\d+)?)", 1), ",", "").try_cast("double")


# --- fixed values: a rating, and the wait that a provider states ---
RATING = r"(?i)\b([0-4](?:\.\d)?|5(?:\.0)?)(?=\s*(?:/\s*5|★|stars?|out of 5|$|\s))"
RETRY = r"(?i)try again in\s+(?:(\d+)m)?\s*([\d.]+)s"


def parse_rating(c: ColumnLike) -> Column:
    """A number of 0 to 5 that stands alone or before stars; null if there is none."""
    x = F.regexp_extract(col(c), RATING, 1)
    return x.try_cast("double")


def retry_after_seconds(c: ColumnLike) -> Column:
    """The wait that a provider's message states, plus 5 s, at most 1800; null if it states none."""
    m, s = (F.regexp_extract(col(c), RETRY, i) for i in (1, 2))
    return F.when(s != "", F.least(F.lit(1800.0), F.coalesce(m.try_cast("double"), F.lit(0.0)) * 60 + s.try_cast("double") + 5))


def _digit_source() -> str:
    return "".join(chr(ord(b) + i) for b in P.DIGIT_BLOCKS for i in range(10))


_CAPTION = f"lower(trim(regexp_replace(regexp_replace(regexp_replace(s, r'[\\u200B-\\u200D\\uFEFF\\u200E\\u200F\\u00A0\\u202A-\\u202E]', ' '), r'[•·|—–-]+', ' '), r'[{P.WHITE}]+', ' ')))"
_WORDS = r"filter(split(lower(trim(s)), r'\s+'), w -> length(w) > 2)"
_SHARED = "(greatest(least(ax + aw, bx + bw) - greatest(ax, bx), 0) * greatest(least(ay + ah, by + bh) - greatest(ay, by), 0))"

#: name -> result type and body over s, for SQL.
SQL = {
    "luhn_valid": ("BOOLEAN", "length(regexp_replace(s, '[^0-9]', '')) BETWEEN 13 AND 19 AND aggregate(transform(split(reverse(regexp_replace(s, '[^0-9]', '')), ''), (c, i) -> CASE WHEN i % 2 = 0 THEN int(c) WHEN 2 * int(c) > 9 THEN 2 * int(c) - 9 ELSE 2 * int(c) END), 0, (a, x) -> a + x) % 10 = 0"),
    "verhoeff_valid": ("BOOLEAN", f"length(regexp_replace(s, '[^0-9]', '')) >= 2 AND aggregate(transform(split(reverse(regexp_replace(s, '[^0-9]', '')), ''), (c, i) -> struct(int(c) AS x, i AS i)), 0, (a, p) -> int(substr('{flat(P.VERHOEFF_D)}', a * 10 + int(substr('{flat(P.VERHOEFF_P)}', (p.i % 8) * 10 + p.x + 1, 1)) + 1, 1))) = 0"),
    "normalize_digits": ("STRING", f"translate(s, '{_digit_source()}', '{'0123456789' * len(P.DIGIT_BLOCKS)}')"),
    "fold_ocr_digits": ("STRING", f"translate(s, '{''.join(P.OCR_DIGITS)}', '{''.join(P.OCR_DIGITS.values())}')"),
    "keyword_form": ("STRING", f"lower(trim(regexp_replace(regexp_replace(regexp_replace(s, '([a-z0-9])([A-Z])', '$1 $2'), '[_.-]+', ' '), r'[{P.WHITE}]+', ' ')))"),
    "is_app_chrome": ("BOOLEAN", f"coalesce({_CAPTION} IN ({', '.join(repr(x) for x in P.CHROME)}) OR {_CAPTION} RLIKE r'^\\d+ unread(?: messages?)?$' OR startswith({_CAPTION}, 'not a contact'), false)"),
    "parse_rating": ("DOUBLE", rf"try_cast(regexp_extract(s, r'{RATING}', 1) AS DOUBLE)"),
    "retry_after_seconds": ("DOUBLE", f"CASE WHEN regexp_extract(s, r'{RETRY}', 2) <> '' THEN least(1800D, coalesce(try_cast(regexp_extract(s, r'{RETRY}', 1) AS DOUBLE), 0D) * 60 + try_cast(regexp_extract(s, r'{RETRY}', 2) AS DOUBLE) + 5) END"),
    "parse_price": ("DOUBLE", "try_cast(replace(regexp_extract(s, '([0-9][0-9,]*([.][0-9]+)?)', 1), ',', '') AS DOUBLE)"),
}

TWO_BOXES = ", ".join(f"{b}{c} DOUBLE" for b in "ab" for c in "xywh")
#: Those of more than one text: name -> parameters, result type and body.
SQL_OF_MORE = {
    "text_similarity": ("s STRING, element STRING", "DOUBLE", f"CASE WHEN coalesce(length(s), 0) = 0 OR coalesce(length(element), 0) = 0 THEN 0D WHEN contains(lower(trim(element)), lower(trim(s))) THEN 1D WHEN contains(lower(trim(s)), lower(trim(element))) AND length(trim(element)) > 3 THEN 0.8D ELSE coalesce(size(filter({_WORDS}, w -> contains(lower(trim(element)), w))) / nullif(size({_WORDS}), 0), 0D) END"),
    "box_iou": (TWO_BOXES, "DOUBLE", f"CASE WHEN aw * ah + bw * bh - {_SHARED} > 0 THEN {_SHARED} / (aw * ah + bw * bh - {_SHARED}) ELSE 0D END"),
    "box_coverage": (TWO_BOXES, "DOUBLE", f"CASE WHEN aw * ah > 0 THEN {_SHARED} / (aw * ah) ELSE 0D END"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions temporary SQL functions; the optimizer puts their bodies in place."""
    for name, (parameters, kind, body) in ({k: ("s STRING", *v) for k, v in SQL.items()} | SQL_OF_MORE).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
