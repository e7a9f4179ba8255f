"""License scans: an exact set-similarity join between the blocks of a text and license templates.

Only DataFrame functions. A block is a line, a sentence, or, so that notices may wrap and hold several sentences, a window
over the words of the whole text: twice as wide as the template, a new one every template's width, so that each stretch of
a template's width lies in one. A block meets a template if it holds at least THRESHOLD of the template's different words. Where the
template's version number (words of digits) isn't among them, the label is that of the family, without a version; a row that has a label
with a version doesn't also have its family's. Windows are made for the templates that the text as a whole meets.

Lines and sentences are joined by filters. Words are ordered by how many blocks of the corpus hold them, rarest first; a block that
meets a template of n words holds one of the template's first n - ceil(THRESHOLD * n) + 1 words (prefix filter), has at
least ceil(THRESHOLD * n) words of templates (length filter), and enough of them after the shared word (positional filter).
"""

from __future__ import annotations

import functools
import math
import operator
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: What separates words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.9
#: Phrases that count wherever their words stand in a row, and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Templates by label.
TEMPLATES = {
    "mit": ["under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "apache-2": ["under the apache license version 2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses"],
    "cc-by-nc": ["under cc by nc", "creative commons attribution noncommercial license"],
    "cc-by-sa": ["under cc by sa", "creative commons attribution sharealike license"],
    "gpl-3": ["under the gnu general public license version 3", "gnu general public license as published by the free software foundation either version 3 of the license"],
    "gpl-2": ["under the gnu general public license version 2", "gnu general public license as published by the free software foundation either version 2 of the license"],
    "lgpl": ["under the gnu lesser general public license"],
    "agpl-3": ["under the gnu affero general public license"],
    "mpl-2": ["subject to the terms of the mozilla public license"],
    "bsd": ["under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
}


def needed(n: int, threshold: float = THRESHOLD) -> int:
    return math.ceil(threshold * n - 1e-9)


def numbered(templates: dict[str, list[str]]) -> list[tuple[int, tuple[str, list[str]]]]:
    """Each template's number, and its label and words."""
    return list(enumerate((label, t.split()) for label, texts in templates.items() for t in texts))


def versions(words: list[str]) -> list[str]:
    return sorted({w for w in words if w.isdigit()})


def family(label: str) -> str:
    """The label less a version at its end."""
    return re.sub(r"-\d+$", "", label)


def without_families(labels: Column, templates: dict[str, list[str]]) -> Column:
    """labels less those of families of which a version is there too."""
    for name in sorted({family(x) for x in templates} - set(templates)):
        told = F.array(*(F.lit(x) for x in templates if family(x) == name))
        labels = F.when(F.arrays_overlap(labels, told), F.array_remove(labels, name)).otherwise(labels)
    return labels


def may_hold(phrases: dict[str, str]) -> Column:
    """Whether a phrase may stand in column lines: by its longest word, or all of it if its words are short."""
    longest = [(max(p.split(), key=len), p) for p in phrases]
    hints = [F.contains("lines", F.lit(w)) for w in sorted({w for w, _ in longest if len(w) > 4})]
    hints += [F.col("lines").rlike(r"\s+".join(re.escape(w) for w in p.split())) for word, p in longest if len(word) <= 4]
    return functools.reduce(operator.or_, hints)


def scan_blocks(docs: DataFrame, templates: dict[str, list[str]], phrases: dict[str, str], threshold: float) -> DataFrame:
    """docs with n_words, flat (two blanks between words; only where a phrase may stand), blocks (each line's and sentence's
    different template words), met (numbers of the templates that the whole text meets) and, where there are some, places:
    where the text's template words stand."""
    vocabulary = sorted({w for texts in templates.values() for t in texts for w in t.split()})
    kept = [c for c in docs.columns if c != "text"]
    # U+212A is the one letter beyond ASCII whose lower case is an ASCII letter; here it stays beyond
    low = F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit("\u212a"), F.lit("\ue000")))
    flat = F.regexp_replace(F.regexp_replace(low, r"(?<=[.!?;])[\x20\x09-\x0D]+", "\n"), r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    df = docs.select(*kept, flat.alias("lines"))
    words = F.transform(F.split("lines", "\n"), lambda b: F.array_remove(F.split(b, " "), ""))
    df = df.select(*kept, words.alias("words"), F.when(may_hold(phrases), F.col("lines")).alias("lines"))
    n_words = F.aggregate("words", F.lit(0).cast("long"), lambda a, b: a + F.size(b))
    blocks = F.filter(F.transform("words", lambda b: F.array_distinct(F.filter(b, lambda w: w.isin(vocabulary)))), lambda b: F.size(b) > 0)
    joined = F.concat(F.lit(" "), F.array_join(F.flatten("words"), "  "), F.lit(" "))
    df = df.select(*kept, "words", n_words.alias("n_words"), F.when(F.col("lines").isNotNull(), joined).alias("flat"), blocks.alias("blocks"))
    df = df.withColumn("all", F.array_distinct(F.flatten("blocks")))
    met = []
    for i, (_, words) in numbered(templates):
        words = sorted(set(words))
        met.append(F.when(F.size(F.array_intersect("all", F.array(*(F.lit(w) for w in words)))) >= needed(len(words), threshold), F.lit(i)))
    df = df.withColumn("met", F.array_compact(F.array(*met)))
    places = F.filter(F.transform(F.flatten("words"), lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda p: p["word"].isin(vocabulary))
    return df.select(*kept, "n_words", "flat", "blocks", "met", F.when(F.size("met") > 0, places).alias("places"))


def phrase_columns(df: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """n_base, first_word, last_word and base (labels) from flat."""
    count, first, last, labels = F.lit(0).cast("long"), [], [], []

    def spaces(x: Column) -> Column:
        return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))

    for phrase, label in phrases.items():
        wide, size = f" {phrase.replace(' ', '  ')} ", len(phrase.split())
        found = F.coalesce(F.contains("flat", F.lit(wide)), F.lit(False))
        count = count + F.when(found, (F.length("flat") - F.length(F.replace("flat", F.lit(wide), F.lit("")))) / len(wide)).otherwise(0).cast("long")
        first.append(F.when(found, (spaces(F.substring_index("flat", wide, 1)) / 2).cast("long")))
        last.append(F.when(found, F.col("n_words") - size - (spaces(F.substring_index("flat", wide, -1)) / 2).cast("long")))
        labels.append(F.when(found, F.lit(label)))
    return df.withColumns({"n_base": count, "first_word": F.least(*first) if len(first) > 1 else first[0], "last_word": F.greatest(*last) if len(last) > 1 else last[0], "base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))})


def told_label() -> Column:
    """The template's label, or its family's where the words lack the version."""
    return F.when(F.size(F.array_except("version", "words")) == 0, F.col("label")).otherwise(F.regexp_replace("label", r"-\d+$", "")).alias("label")


def template_hits(df: DataFrame, key: str, templates: dict[str, list[str]], threshold: float) -> DataFrame:
    """key, label, share: the best containment for each label that a line or sentence of the row meets."""
    spark = df.sparkSession
    blocks = df.select(key, F.posexplode("blocks").alias("block", "words"))
    rank = blocks.select(F.explode("words").alias("word")).groupBy("word").count().collect()  # as many rows as the templates have words
    seen = {r["word"]: r["count"] for r in rank}
    rows = []
    for label, texts in templates.items():
        for text in texts:
            words = sorted(set(text.split()), key=lambda w: (seen.get(w, 0), w))
            least = needed(len(words), threshold)
            rows += [(w, i, label, words, least, versions(words)) for i, w in enumerate(words[: len(words) - least + 1])]
    prefixes = F.broadcast(spark.createDataFrame(rows, "word string, at int, label string, template array<string>, least int, version array<string>"))  # bounded by the templates
    order = F.create_map(*(x for i, w in enumerate(sorted({w for r in rows for w in r[3]}, key=lambda w: (seen.get(w, 0), w))) for x in (F.lit(w), F.lit(i))))
    smallest = min(r[4] for r in rows)
    blocks = blocks.filter(F.size("words") >= smallest)
    ordered = F.transform(F.array_sort(F.transform("words", lambda w: F.struct(order[w].alias("i"), w.alias("w")))), lambda p: p["w"])
    pairs = blocks.select(key, "block", ordered.alias("words")).select(key, "words", F.posexplode("words").alias("own", "word")).join(prefixes, "word")
    rest = F.least(F.size("template") - F.col("at"), F.size("words") - F.col("own"))
    pairs = pairs.filter((F.size("words") >= F.col("least")) & (rest + F.least("at", "own") >= F.col("least")))
    shared = F.size(F.array_intersect("words", "template"))
    pairs = pairs.filter(shared >= F.col("least")).select(key, told_label(), (shared / F.size("template")).alias("share"))
    return pairs.groupBy(key, "label").agg(F.max("share").alias("share"))


def window_hits(df: DataFrame, key: str, templates: dict[str, list[str]], threshold: float) -> DataFrame:
    """key, label, share: the best containment for each label that a window of the row meets."""
    rows = [(w, i, label, len(words), len(set(words)), needed(len(set(words)), threshold), versions(words)) for i, (label, words) in numbered(templates) for w in sorted(set(words))]
    told = F.broadcast(df.sparkSession.createDataFrame(rows, "word string, number int, label string, width int, size int, least int, version array<string>"))  # bounded by the templates
    at = df.filter("places is not null").select(key, "met", F.inline("places")).join(told, "word").filter(F.array_contains("met", F.col("number")))
    own = F.floor(F.col("at") / F.col("width"))
    at = at.select(key, "word", "number", "label", "size", "least", "version", F.explode(F.array(own - 1, own)).alias("window"))
    met = at.groupBy(key, "number", "window").agg(F.first("label").alias("label"), F.first("size").alias("size"), F.first("least").alias("least"), F.first("version").alias("version"), F.collect_set("word").alias("words"))
    met = met.filter(F.size("words") >= F.col("least")).select(key, told_label(), (F.size("words") / F.col("size")).alias("share"))
    return met.groupBy(key, "label").agg(F.max("share").alias("share"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null, empty or wordless text: 0 words, labels '', score 0. score is the largest share of a template that a block
    holds, 1 where a phrase stands. Rows with the same doc_id are scanned one by one.
    """
    df = phrase_columns(scan_blocks(docs.select("doc_id", "text"), templates, phrases, threshold), phrases).drop("flat")
    df = stored(df.withColumn("row", F.monotonically_increasing_id()), "blocks")
    hits = template_hits(df, "row", templates, threshold).unionByName(window_hits(df, "row", templates, threshold))
    hits = hits.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    df = df.drop("blocks", "met", "places").join(hits, "row", "left")
    labels = F.array_sort(without_families(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))), templates))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return df.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases and licenses of every document: a row each, also for null texts (no words) and for equal rows."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


def _sql() -> str:
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"('{label}', '{family(label)}', {sorted(set(t.split()))}, {needed(len(set(t.split())))}, {len(t.split())}, {versions(t.split())}::VARCHAR[])" for label, texts in TEMPLATES.items() for t in texts)
    families = {name: [x for x in TEMPLATES if family(x) == name] for name in sorted({family(x) for x in TEMPLATES} - set(TEMPLATES))}
    labels = "list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))"
    kept = " AND ".join(f"NOT (x = '{name}' AND list_has_any({labels}, {known}))" for name, known in families.items())
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT r, doc_id, low, list_filter(regexp_split_to_array(low, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM t),
p(phrase, label) AS (VALUES {phrases}),
h AS (SELECT * FROM (SELECT r, label, len(phrase) AS k, phrase, words, unnest(range(len(words) - len(phrase) + 1)) AS i FROM w, p WHERE low LIKE '%' || phrase[1] || '%' AND len(words) >= len(phrase)) WHERE words[i + 1 : i + k] = phrase),
b AS (SELECT r, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS labels FROM h GROUP BY r),
k AS (SELECT r, list_distinct(regexp_split_to_array(unnest(regexp_split_to_array(regexp_replace(low, '([.!?;])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10))), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS words FROM w),
m(label, family, template, least, width, version) AS (VALUES {templates}),
v AS (SELECT r, m.*, words, unnest(range(len(words) // width + 1)) AS v FROM w, m WHERE len(list_intersect(list_distinct(words), template)) >= least),
c AS (SELECT r, label, family, template, least, version, words FROM k, m WHERE len(words) >= least
  UNION ALL SELECT r, label, family, template, least, version, list_distinct(words[v * width + 1 : (v + 2) * width]) FROM v),
n AS (SELECT r, CASE WHEN len(list_filter(version, lambda x: NOT list_contains(words, x))) = 0 THEN label ELSE family END AS label, len(list_intersect(words, template)) AS n, len(template) AS size, least FROM c),
f AS (SELECT r, list_distinct(list(label)) AS labels, max(n / size) AS share FROM n WHERE n >= least GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.first_word, b.last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_filter({labels}, lambda x: {kept})), ','), '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN f USING (r)
"""


OP5_SQL = _sql()
