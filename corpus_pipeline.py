"""From raw documents to token files: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns rows; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.llm import decontamination, importance, mixing, ngram_join, token_files
from maskline.llm.common import LAST_ID, discard, id_text, stored, without

#: Near duplicates of the corpus: similarity in percent, and words of a shingle (op1_ngram_join has its own).
NEAR_PERCENT, NEAR_WORDS = 80, 5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return importance.drawn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.one_of_each(docs, percent=NEAR_PERCENT, size=NEAR_WORDS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontamination.leaks(id_text(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("leak")
    return without(docs, found.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("its_doc"), "text_hash").distinct())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small languages come more than once; every document comes at least once."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    mixed = mixing.mix(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), floor=1.0, keep=["whole"])
    return mixed.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files, and what they hold of each document."""
    return token_files.digest(spark, docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: SQL can't express the classifier, the joins and the tokenizer; tests/llm/test_pipeline.py checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
