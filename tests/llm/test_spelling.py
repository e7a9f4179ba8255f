"""Spelling variants against all pairs, with blocks that must split."""

import random
import re
import zlib
from collections import Counter

import pytest

from maskline.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(counts):
    names, out = list(counts), {}
    for w in names:
        others = [x for x in names if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best is not None and counts[best] >= 10 * counts[w] else None, len(others))
    rows = []
    for w, (form, n) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, counts[w], n, counts[form] if form else None))
    return sorted(rows)


def words_by_hand(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def found(spark, counts, block):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted((tuple(r) for r in spelling.variants(df, block=block).collect()))


@pytest.mark.parametrize("block", [2, 16, 2048])
def test_all_pairs_at_any_block_size(spark, block):
    """Words over two letters and near copies of them: most meet many others, in repeated letters too; ties of n."""
    draw = random.Random(5)
    names = {"".join(draw.choice("aé") for _ in range(draw.randint(7, 10))) for _ in range(150)}
    names |= {"".join(draw.choice("abcdefÀÿß×") for _ in range(draw.randint(7, 12))) for _ in range(40)}
    for w in sorted(names)[:60]:
        k = draw.randrange(len(w))
        names |= {w[:k] + w[k + 1 :] + "z", w[:k] + "y" + w[k:], w[:k] + "x" + w[k + 1 :]}
    counts = {w: draw.choice([2, 3, 20, 30, 200, 2000]) for w in sorted(names)}
    assert found(spark, counts, block) == by_hand(counts)


def test_long_words(spark):
    long = "ab" * 4000
    counts = {long: 100, long[:-1]: 3, long[:10] + "z" + long[11:]: 5, "k" * 9000: 2, "k" * 9001: 40}
    assert found(spark, counts, 2) == by_hand(counts)


def test_words_of_documents(spark):
    text = "Example example EXAMPLE naïveté Straße ÀÉÎÕÜß words of Seven and exampl examples, examples; über-mäßig mäßigst mäßigst"
    rows = [(i, text) for i in range(70)] + [(3, text), (None, text), (None, None), (5, None), (6, ""), (7, "wordless 123"), (8, "longtext " * 200_000)]
    df = spark.createDataFrame([(d, "x", t, 1) for d, t in rows], "doc_id long, word string, text string, n int")
    assert {r["word"]: r["n"] for r in spelling.words(df).collect()} == words_by_hand(rows)
    assert spelling.variants(spelling.words(df.limit(0))).collect() == []
