"""Importance resampling, decontamination and mixing."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskline.llm import decontamination, importance, mixing

GOOD = "The river ran past the old mill and the children walked along its bank to school each morning"
BAD = "CLICK!! HERE!! NOW!! *** $$$ BUY!! BUY!! BUY!!"


def corpus(spark):
    rows = [(i, (GOOD + f" day {i}.") if i % 4 else BAD + f" {i}") for i in range(200)] + [(900, None), (901, ""), (902, GOOD * 300)]
    labels = [(i, 1 if i % 4 else 0) for i in range(100)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_importance_keeps_what_looks_like_the_target(spark):
    docs, labels = corpus(spark)
    got = {r["doc_id"]: r["kept"] for r in importance.draw(docs, labels).collect()}
    assert len(got) == 203 and all(got[i] == bool(i % 4) for i in range(200)) and got[902]


def test_importance_without_labels_keeps_all(spark):
    docs, labels = corpus(spark)
    assert importance.draw(docs, labels.filter("false")).filter("kept").count() == 203
    assert importance.draw(docs.filter("false"), labels).count() == 0


def test_top_k_is_exact(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(50))).cast("double").alias("noisy"))
    want = sorted(((-r["noisy"], r["doc_id"]) for r in df.collect()))
    for k in (0, 1, 17, 500, 999, 1000):
        got = {r["doc_id"] for r in df.filter(importance.among(importance.last_of_k(df, k))).collect()}
        assert got == {d for _, d in want[:k]}


def test_top_k_by_narrowing(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.log(F.pmod(F.xxhash64("id"), F.lit(3000)) + 1).alias("noisy"))
    want = sorted(((-r["noisy"], r["doc_id"]) for r in df.collect()))
    for k in (3, 2500, 4990):
        assert {r["doc_id"] for r in df.filter(importance.among(importance.last_of_k(df, k, ranked=10))).collect()} == {d for _, d in want[:k]}


def test_inclusion_rates_follow_the_weights(spark):
    """Half of the rows weigh three times as much: rates as in drawing one by one in proportion to the weights."""
    n, k, seeds, rng = 200, 60, range(60), np.random.default_rng(0)
    noise = spark.range(n).select(F.col("id").alias("doc_id")).select("doc_id", *(importance.gumbel(s).alias(f"s{s}") for s in seeds)).orderBy("doc_id").toPandas()
    weights = np.where(np.arange(n) < n // 2, 3.0, 1.0)
    drawn = [(np.argsort(-(np.log(weights) + noise[f"s{s}"].to_numpy()))[:k] < n // 2).sum() for s in seeds]
    wanted = [(rng.choice(n, k, False, weights / weights.sum()) < n // 2).sum() for _ in range(2000)]
    assert abs(np.mean(drawn) - np.mean(wanted)) < 4 * np.std(wanted) / len(seeds) ** 0.5


def brute_features(text):
    """Buckets of a text's features, one by one."""
    tokens = re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+", (text or "").encode())
    h = [importance.TokenHashes().make(t) for t in tokens]
    shape = [(x & 63) * 2 + (x in h[max(0, i - 4) : i]) for i, x in enumerate(h)]
    values = h + [a * 0x9E3779B97F4A7C15 + b for a, b in zip(h, h[1:])]
    values += [x + 0xD6E8FEB86659FD93 for x in shape] + [(a << 16) + b + 0xA5A5A5A5A5A5A5A5 for a, b in zip(shape, shape[1:])]
    return [int(importance.mixed(np.array([v % 2**64], np.uint64))[0]) % importance.BUCKETS for v in values]


def test_importance_weights_against_brute_force(spark):
    docs, labels = corpus(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    buckets = {d: brute_features(t) for d, t in texts.items()}
    raw, target = np.ones(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for d, b in buckets.items():
        np.add.at(raw, b, 1)
        if d < 100 and d % 4:
            np.add.at(target, b, 1)
    ratios = np.log((target + importance.PRIOR) / (raw / raw.sum() * target.sum() + importance.PRIOR))
    got = {r["doc_id"]: r for r in importance.draw(docs, labels).collect()}
    for d, b in buckets.items():
        assert got[d]["log_weight"] == pytest.approx(ratios[b].sum() / 4 * min(1, importance.EVIDENCE / max(1, len(b) / 4)))
    assert sum(r["kept"] for r in got.values()) == round(0.75 * len(texts))
    assert importance.draw(docs, labels, share=0.1).filter("kept").count() == 20


def test_drawn_rows_keep_their_columns(spark):
    docs, labels = corpus(spark)
    docs = docs.withColumn("noisy", F.lit("n")).withColumn("good", F.lit(1)).withColumn("a.b", F.lit(2))
    got = importance.drawn(docs, labels)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} >= {i for i in range(200) if i % 4}


def brute_tiles(a, b, least):
    """Greedy string tiling by trying every pair of places."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = max(((n, -j, -i) for i in range(len(a)) for j in range(len(b)) if (n := run(a, b, i, j, used_a, used_b)) >= least), default=None)
        if best is None:
            return out
        n, j, i = best[0], -best[1], -best[2]
        out.append((i, j, n))
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))


def run(a, b, i, j, used_a, used_b):
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
        n += 1
    return n


def test_tiles_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (rng.integers(0, 3, rng.integers(1, 40)).astype(np.uint64) for _ in range(2))
        got = decontamination.tiles(a, b, 3)
        for i, j, n in got:
            assert (a[i : i + n] == b[j : j + n]).all()
        assert len({x for i, _, n in got for x in range(i, i + n)}) == sum(n for *_, n in got) == len({x for _, j, n in got for x in range(j, j + n)})
        assert max((n for *_, n in got), default=0) == max((n for i in range(len(a)) for j in range(len(b)) if (n := run(a, b, i, j, set(), set())) >= 3), default=0)
        assert [n for *_, n in got] == sorted((n for *_, n in got), reverse=True)
        assert got == brute_tiles(a.tolist(), b.tolist(), 3)


def test_leaks(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    w = item.split()
    docs = [(1, "before " + item.upper() + ", after"), (2, " ".join(w[6:] + ["x"] + w[:6])), (3, " ".join(w[:5])), (4, "nothing here"), (5, None), (6, ""), (7, "tiny, thing"), (8, "x " * 20000 + item), (1, "before " + item.upper() + ", after")]
    items = [(10, item), (11, "Tiny thing"), (12, None), (13, "...")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.leaks(docs, items, below_too=True).collect()
    assert sorted(map(str, decontamination.leaks(docs, items).filter("leak").collect())) == sorted(str(r) for r in rows if r["leak"])
    assert sorted((r["doc_id"], r["item_id"]) for r in rows if r["leak"]) == [(1, 10), (1, 10), (2, 10), (7, 11), (8, 10)]
    assert {r["doc_id"]: r["covered"] for r in rows if not r["leak"]} == {3: 5}
    assert {r["n_tiles"] for r in rows if r["doc_id"] == 2} == {2}


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(docs, items).count() == decontamination.leaks(docs.filter("false"), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def mixed_corpus(spark):
    rows = [(i, "der und die zeit ist heute schön und gut" if i % 5 == 0 else "the cat sat with the hat on that mat", "de" if i % 5 == 0 else "en", "x") for i in range(100)]
    rows += [(200, None, "en", "x"), (201, "", None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, rate string"), spark.createDataFrame([(i,) for i in range(50)], "doc_id long")


def test_telling_features_are_learnt_in_any_script(spark):
    rows = [("ru", "мама мыла раму и окно"), ("el", "η γάτα και ο σκύλος"), ("ja", "猫 は 犬 と 遊ぶ")] * 20 + [(None, "x"), ("ru", None)]
    found = mixing.telling(spark.createDataFrame(rows[:60], "domain string, low string"), letters=6)
    assert len(found) == 6 and not set(found) & set("x ")
    docs = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(rows)], "doc_id long, lang string, text string")
    got = mixing.mix(docs, docs.select("doc_id")).filter("n_tokens > 1").collect()
    assert all(r["domains"][int(np.argmax(r["p"]))] == r["lang"] for r in got)


def test_mixing_meets_its_targets(spark):
    docs, labels = mixed_corpus(spark)
    df = mixing.mix(docs, labels, weights={"en": 0.5, "de": 0.5})
    rows = [r for r in df.collect()]
    totals = np.sum([np.array(r["p"]) * r["rate"] * r["n_tokens"] for r in rows], 0)
    assert totals == pytest.approx([450, 450], rel=0.01)
    assert all(sum(r["p"]) == pytest.approx(1) and r["rate"] >= 0 for r in rows)
    assert all(int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1 for r in rows)


def test_rates_against_plain_projected_gradient(spark):
    rng = np.random.default_rng(3)
    p, n = rng.dirichlet([0.3] * 3, 50), rng.integers(1, 100, 50)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    weights = {"a": 0.7, "b": 0.2, "c": 0.1}
    history, wanted, now = mixing.fit_rates(df, ["a", "b", "c"], weights, 0.0)
    sizes, r = (p * n[:, None]).sum(0), np.ones(50)
    for _ in range(len(history)):
        r = np.maximum(0, r - p @ (((p * (n * r)[:, None]).sum(0) - wanted) / sizes))
    assert now == pytest.approx((p * (n * r)[:, None]).sum(0).tolist())
    assert now == pytest.approx(wanted, rel=0.02)


def test_mixing_with_a_floor_keeps_every_document(spark):
    docs, labels = mixed_corpus(spark)
    rows = mixing.mix(docs, labels, floor=1.0).collect()
    assert len(rows) == 102 and min(r["copies"] for r in rows) == 1
    assert mixing.mix(docs, labels.filter("false")).filter("rate = 1").count() == 102
    assert mixing.mix(docs.filter("false"), labels).count() == 0
