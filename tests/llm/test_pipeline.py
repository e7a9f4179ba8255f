"""The pipeline's stages on a small corpus with planted cases, and with odd rows."""

import os

import corpus_pipeline
import pytest
from maskline.llm import token_files
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def planted(spark, path):
    item = "what is the capital city of the northern province and when was it founded by the settlers"
    good = "The river ran past the old mill and the children walked along its bank to school each morning of year"
    rows = [(i, f"{good} {i} {i * 7} {i * 13} " + " ".join(f"w{(i * k) % 97}x{k}" for k in range(20)), ["en", "de"][i % 9 == 0], "s", 1) for i in range(120)]
    rows += [(200 + i, "CLICK!! *** BUY!! $$$ " * 30 + str(i), "en", "s", 1) for i in range(40)]
    rows += [(300, rows[5][1], "en", "s", 1), (301, rows[6][1] + " more", "en", "s", 1), (302, rows[7][1] + " " + item, "en", "s", 1), (303, None, None, None, None), (304, "", "en", "s", 0), (5, rows[5][1], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(200 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_planted_cases(spark, tmp_path):
    path = str(tmp_path)
    planted(spark, path)
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        kept.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
    assert not [x for x in kept[0] if 200 <= x < 240] and set(range(120)) <= set(kept[0])
    rest = [x for x in kept[1] if x < 303]
    assert rest == [*range(120), 302]
    assert [x for x in kept[2] if x < 303] == list(range(120))
    assert set(kept[3]) == set(kept[2]) and len(kept[3]) > len(kept[2])
    out = corpus_pipeline.write_tokens(spark, docs, path)
    assert sorted(r["doc_id"] for r in out.collect()) == kept[3]


def test_join_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted({d for d, _, c in brute(rows) if d == c})
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()) == want


def test_join_stage_takes_five_words_and_eighty_percent(spark):
    """Two of 100 words changed: 86 / 106 of the 5-word shingles, only 89 / 105 of the 4-word ones. A third change leaves 81 / 111."""
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(f"x{i}" if i in odd else w for i, w in enumerate(words)) for odd in ((), (30, 60), (20, 50, 80))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()) == [0, 2]


def test_stages_take_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    rows.sort(key=lambda r: r["start"])
    assert rows[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    assert token_files.END_ID == 2
