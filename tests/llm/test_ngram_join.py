import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskline.llm import ngram_join
from maskline.llm.graph import components


def sets_of(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(rows):
    sets, least = [sets_of(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                least[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(groups[root(i)])) for i in range(len(rows)))


def near_copies(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [rng.choice(words) for _ in range(30)]
    bases, rows = [[rng.choice(words) for _ in range(rng.choice([3, 8, 60, 75, 120]))] for _ in range(25)], []
    for i in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            k = rng.randrange(len(t))
            t[k : k + rng.randint(0, 2)] = [rng.choice(words) for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.3:
            t += shared
        rows.append((i, " ".join(t).title() if i % 7 == 0 else "  ".join(t)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "One Two"), (n + 5, "x " * 30000)]


@pytest.mark.parametrize("seed,block,often", [(1, 1024, 8), (2, 16, 2)])
def test_components_against_brute_force(spark, monkeypatch, seed, block, often):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "OFTEN", often)
    rows = near_copies(seed)
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, n int, sid string").repartition(5)
    got = ngram_join.linked(df.select("doc_id", "text"))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows)


def test_pairs_of_trees_are_all_there():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = []
    for _ in range(150):
        keep = base[rng.random(300) < rng.choice([0.3, 0.9, 0.97])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 60, rng.integers(0, 15)).astype(np.uint64)])))
    n = np.array([len(s) for s in sets])
    for side in (np.zeros(150, int), np.arange(150) % 2):
        x, y, _ = ngram_join.possible_links([ngram_join.signature(s).tobytes() for s in sets], n, side, 85)
        found = {frozenset(p) for p in zip(x.tolist(), y.tolist())}
        assert len(found) == len(x)
        for i in range(150):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (n[i] + n[j] - both) and (not side.any() or side[i] != side[j]):
                    assert frozenset((i, j)) in found


def test_same_id_null_id_and_empty_table(spark):
    t = " ".join(f"v{i}" for i in range(40))
    rows = [(5, t), (5, "other words in this one here"), (None, t), (3, t + " more"), (9, "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngram_join.linked(df).collect()))
    assert got == [(-1, 37, 3), (3, 38, 3), (5, 3, 5), (5, 37, 3), (9, 1, 9)]
    assert ngram_join.linked(df.filter("false")).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    least = {}
    for a, b in edges:
        for v in (a, b):
            least.setdefault(v, v)
    for _ in range(400):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in least.items() if any(k in e and e[0] != e[1] for e in edges)}
