import zlib

import numpy as np
from tokenizers import Tokenizer

from maskline.llm import token_files as tf

TEXTS = ["Hello  World, it's ÉCOLE 123\n<|endoftext|>x", "", None, "a" * 3000 + " é́ b\x1cc d", "the the", "tie", "tie", "## #!! 中文 🙂 KK"]


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(i * 3 % 17 if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, part string")


def test_round_trip_matches_the_tokenizer(spark):
    docs = rows(spark)
    tokenizer = Tokenizer.from_file(tf.tokenizer_path())
    want = sorted(((i * 3 % 17 if i else None), tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in list(enumerate(TEXTS))[1:])
    want = [(None, tokenizer.encode(TEXTS[0], add_special_tokens=False).ids + [2]), *want]
    got = sorted(tf.digest(spark, docs).collect(), key=lambda r: r["start"])
    start = 0
    for r, (doc, ids) in zip(got, want, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_flat_files_are_mapped(spark, tmp_path):
    path = str(tmp_path / "t")
    tf.write(tf.id_text(rows(spark)), path, tf.tokenizer_path(), part_bytes=1000)
    mapped = tf.MappedTokens(path, "<u2")
    read = sorted(tf.read(spark, path, "<u2").collect(), key=lambda r: r["start"])
    assert len(mapped) == len(TEXTS) == len(read)
    for i, r in enumerate(read):
        assert mapped[i].astype("<u4").tobytes() == bytes(r["ids"])


def test_wide_ids_and_other_end(spark, tmp_path):
    path, end = str(tmp_path / "w"), 50256
    tokenizer = tf.tokenizer_path("byte_bpe_50k.json")
    assert tf.id_kind(tokenizer, end) == "<u4"
    tf.write(tf.id_text(spark.createDataFrame([(1, "a b")], "doc_id long, text string")), path, tf.tokenizer_path(), end_id=end)
    (r,) = tf.read(spark, path, "<u2" if end < 256 else "<u4").collect()
    assert np.frombuffer(bytes(r["ids"]), "<u4")[-1] == end


def test_empty_table(spark):
    assert tf.digest(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
