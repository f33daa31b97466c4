"""The corpus pipeline: documents through five stages, each written as Parquet and read back.

Toxic documents go, one document of each near-duplicate group stays, documents that hold a
benchmark item go, small sources are repeated toward the target mixture, and what is left is dealt
into shards. A stage's DataFrame may rest on scratch tables in the shared folder. Columns beside
those of documents are left out before the first stage, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import common, decontaminate, mixing, ngram_join, sharding, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
N_SHARDS = 40


def _without(docs: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    """docs whose doc_id is not among ids."""
    return docs.join(common.small(common.staged(ids, tag)), "doc_id", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go, each row by its own text; null and empty texts and null doc_ids stay."""
    labels = toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, labels, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each component stays, and one row of it; rows with a null doc_id stay."""
    groups = common.staged(ngram_join.jaccard_components(docs), "stage-groups")
    left = _without(docs, groups.where("doc_id <> component_id").select("doc_id"), "stage-copies")
    twice = groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = common.staged(twice.select("doc_id"), "stage-repeats")
    if twice.isEmpty():
        return left
    once = left.join(common.small(twice), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(common.small(twice), "doc_id", "left_anti").unionByName(once).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows with a null doc_id stay."""
    leaks = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, leaks.select("doc_id").distinct(), "stage-leaks")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that small sources gain weight; every document stays at least once."""
    return mixing.mix_sources(docs, target_entropy=0.9, max_repeats=1.5, tag="stage-mix").select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot."""
    return sharding.interleave_shards(docs, N_SHARDS, key=["doc_id"])


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", shard)]
#: SQL can't express the fitted toxicity model nor the similarity join; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = common.scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
