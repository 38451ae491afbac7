"""From raw documents to a sharded training mix: language, near duplicates, benchmarks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps; ``run`` writes each stage's rows
as Parquet to the shared folder and reads them again as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, mixing, ngramjoin, sharding
from tidemark.llm.common import removed, saved, shared_dir, shuffles_removed

SHARDS = 24


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the labels teach; those without text, or a letter, go."""
    return langid.known(docs, langid.fit(docs))


def keep_one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near duplicates, once; rows without an id stay."""
    groups = saved(ngramjoin.components(docs))
    kept = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    once = kept.where("rows = 1").select("doc_id")
    often = saved(kept.where("rows > 1").select("doc_id"))
    first = Window.partitionBy("doc_id").orderBy(*[F.col(f"`{c}`") for c in docs.columns])
    rest = docs.join(often, "doc_id", "left_semi").withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    parts = [docs.join(once, "doc_id", "left_semi"), rest, docs.where("doc_id is null")]
    return parts[0].select(*_columns(docs)).union(parts[1].select(*_columns(docs))).union(parts[2].select(*_columns(docs)))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is taken."""
    return mixing.mixed(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their place in it, which replace columns of these names."""
    placed = sharding.shard(docs, SHARDS, carry=True)
    return placed.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", keep_one_of_a_kind),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("mixing", mix_to_targets),
    ("sharding", place_in_shards),
]

#: The first stage's models can't be expressed in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole table documents.

    Each stage's rows are in a folder of the shared one until the next stage's are written; those that the last stage reads stay.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    done = None
    for name, stage in STAGES[:-1]:
        rows = stage(spark, docs, sf_dir)
        with shuffles_removed(spark):
            rows.write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if done:
            removed(spark, done)
        done = f"{top}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
