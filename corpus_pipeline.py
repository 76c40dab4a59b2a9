"""From raw documents to balanced shards: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import documents, free, fresh, materialise, maybe_broadcast
from lorekeep.llm.decontamination import contamination
from lorekeep.llm.mixing import mix_rows
from lorekeep.llm.near_dedup import keep_one
from lorekeep.llm.sharding import shard
from lorekeep.llm.toxicity import keep_clean


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts get the classifier's constant, and very long ones are read whole; rows that repeat an id are judged each
    by its text; without labels of both classes all get the prior, so none go but where only toxic ones are known.
    """
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id; at Jaccard 0.8 of five-word shingles.

    Null and blank texts have no copies, null ids name no document, and both stay; rows of one id go or stay together.
    """
    return keep_one(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row, or a whole shorter item, with the benchmark go.

    Null and empty texts have no words and stay; of rows that repeat an id (or have none) all go if one is hit.
    """
    found, leaked = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), fresh("leaked", docs)
    leaks = materialise(found.where("n_hit > 0").select(F.col("doc_id").alias(leaked)).distinct(), "pipeline-leaked")
    return docs.join(maybe_broadcast(leaks), F.col("doc_id").eqNullSafe(F.col(leaked)), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, up to twice, until the mixture is as flat as that allows; no document is left out.

    A null source is a source; a null or empty text weighs two tokens; rows that tie in the permutation are read alike.
    """
    return mix_rows(docs, max_repetition=2.0)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and its slot there; `copy` (from 0) tells the rows of a document that mixing repeats apart.

    `lorekeep.llm.sharding.shard_texts(documents, result)` gives the shards' rows with their texts.  Null texts and ids are
    values of their own.
    """
    placed = shard(docs, shards=24)
    return placed.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("shard", "slot")) - 1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: A trained classifier, MinHash and a k-d tree are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; a stage's table is deleted once the next one is written.

    Extra columns of `documents` are kept up to the last stage; an empty table gives an empty result; ids are taken as unique,
    and rows that repeat one share its fate.
    """
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        former, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        free(former)
    return docs
