"""Rank fusion, rerank and diversity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.scoring import min_max


def ranked(hits: DataFrame) -> DataFrame:
    """Rank from 1 by score, then id.  Hit lists are top-k results, so one window over all is small."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))


def rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of hit lists (id, score)."""
    votes = reduce(DataFrame.unionByName, [ranked(x).select("id", (1.0 / (F.lit(k) + F.col("rank"))).alias("vote")) for x in lists])
    return votes.groupBy("id").agg(F.round(F.sum("vote"), 6).alias("score"))


def weighted(lists: list[tuple[DataFrame, float]], constant: float = 0.5) -> DataFrame:
    """Sum of min-max normalised scores times their list's weight."""
    everything = Window.partitionBy()
    parts = [h.select("id", (w * min_max(F.col("score"), everything, constant)).alias("part")) for h, w in lists]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.round(F.sum("part"), 6).alias("score"))


def normalised(hits: DataFrame, constant: float = 0.5) -> DataFrame:
    return hits.select("id", F.round(min_max(F.col("score"), Window.partitionBy(), constant), 6).alias("score"))


def cross_tier(first: DataFrame, second: DataFrame, key_chars: int = 80, bonus: DataFrame | None = None) -> DataFrame:
    """0.65 / 0.35 fusion of two tiers of texts (id, text, score), joined by the head of the text, with a bonus of 0.15 for feedback hits."""
    everything = Window.partitionBy()
    head = F.substring(F.lower(F.trim("text")), 1, key_chars)

    def part(df, w):
        return df.select(head.alias("key"), "id", "text", (w * min_max(F.col("score"), everything)).alias("part"))

    fused = part(first, 0.65).unionByName(part(second, 0.35)).groupBy("key").agg(F.min("id").alias("id"), F.min("text").alias("text"), F.sum("part").alias("score"))
    if bonus is not None:
        hit = bonus.select(head.alias("key")).distinct().withColumn("hit", F.lit(0.15))
        fused = fused.join(hit, "key", "left").withColumn("score", F.col("score") + F.coalesce("hit", F.lit(0.0))).drop("hit")
    return fused.drop("key").withColumn("score", F.round("score", 6))


def blend_rerank(hits: DataFrame, other: str, first: float = 0.55) -> DataFrame:
    """Blend of a list's own score and another score column, both min-max normalised."""
    everything = Window.partitionBy()
    score = first * min_max(F.col("score"), everything) + (1 - first) * min_max(F.col(other), everything)
    return hits.withColumn("score", F.round(score, 6))
