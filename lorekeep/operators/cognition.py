"""Structural pattern mining over facts: scans, prototypes, gaps, hypotheses, analogies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def relation_frequency(facts: DataFrame, least: int = 2) -> DataFrame:
    return facts.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("subjects")).where(F.col("n") >= least)


def fanout(facts: DataFrame, side: str = "subject", least: int = 2) -> DataFrame:
    """Per relation and end, how many different other ends; those with at least `least`."""
    other = "value" if side == "subject" else "subject"
    return facts.groupBy("relation", side).agg(F.countDistinct(other).alias("fanout")).where(F.col("fanout") >= least)


def co_occurrence(facts: DataFrame, fraction: float = 0.30, top: int | None = 20) -> DataFrame:
    """Ordered relation pairs (a, b) by the share of a's subjects that have b too; the best `top`, or all in no order."""
    has = facts.select("subject", "relation").distinct()
    sizes = has.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    pairs = (
        has.withColumnRenamed("relation", "a")
        .join(has.withColumnRenamed("relation", "b"), "subject")
        .where("a <> b")
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("shared"))
        .join(sizes.withColumnRenamed("relation", "a"), "a")
    )
    found = pairs.withColumn("fraction", F.round(F.col("shared") / F.col("n"), 6)).where(F.col("fraction") >= fraction).select("a", "b", "shared", "fraction")
    return found if top is None else found.orderBy(F.col("fraction").desc(), F.col("shared").desc(), "a", "b").limit(top)


def relation_pairs(facts: DataFrame) -> DataFrame:
    """Chains: how often a value of relation a is a subject with relation b."""
    a = facts.select(F.col("relation").alias("a"), F.col("value").alias("x")).groupBy("a", "x").agg(F.count(F.lit(1)).alias("na"))
    b = facts.select(F.col("relation").alias("b"), F.col("subject").alias("x")).groupBy("b", "x").agg(F.count(F.lit(1)).alias("nb"))
    return a.join(b, "x").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("n"))


def prototypes(facts: DataFrame, least: int = 2) -> DataFrame:
    """Subjects with the same set of relations, as a role."""
    sets = facts.groupBy("subject").agg(F.array_join(F.sort_array(F.collect_set("relation")), ",").alias("relations"))
    return (
        sets.groupBy("relations")
        .agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("example"))
        .where(F.col("n") >= least)
        .withColumn("confidence", F.round(F.least(F.lit(0.49), 0.10 + 0.05 * F.col("n")), 6))
    )


def gaps(facts: DataFrame, fraction: float = 0.5) -> DataFrame:
    """(subject, relation) that a subject lacks while at least `fraction` of the subjects sharing another relation with it have it.

    Expected relations come from the co-occurrence table, which has one row per pair of relations, so nothing grows
    with subjects times relations but the answer.
    """
    has = facts.select("subject", "relation").distinct()
    expected = co_occurrence(facts, fraction, top=None).select(F.col("a").alias("relation"), F.col("b").alias("missing"), "fraction")
    wanted = has.join(expected, "relation").groupBy("subject", "missing").agg(F.max("fraction").alias("support"))
    return wanted.join(has.withColumnRenamed("relation", "missing"), ["subject", "missing"], "left_anti").select("subject", F.col("missing").alias("relation"), "support")


def majority(facts: DataFrame) -> DataFrame:
    """Per relation the most frequent value, of equals the first; with its support."""
    counts = facts.groupBy("relation", "value").agg(F.count(F.lit(1)).alias("support"))
    w = Window.partitionBy("relation").orderBy(F.col("support").desc(), "value")
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def hypotheses(facts: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Gaps filled with the majority value; confidence grows with its support up to 0.45."""
    filled = gaps(facts, fraction).join(majority(facts).withColumnRenamed("support", "votes"), "relation")
    return filled.select("subject", "relation", "value", F.round(F.least(F.lit(0.45), 0.20 + 0.05 * F.col("votes")), 6).alias("confidence"))


def analogies(facts: DataFrame, key: str = "relation", member: str = "subject", jaccard: float = 0.40, least: int = 2) -> DataFrame:
    """Pairs of keys whose member sets are alike: Jaccard of at least `jaccard`, at least `least` in common."""
    has = facts.select(F.col(key).alias("k"), F.col(member).alias("m")).distinct()
    size = has.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    shared = (
        has.withColumnRenamed("k", "a").join(has.withColumnRenamed("k", "b"), "m").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    ).where(F.col("shared") >= least)
    sized = shared.join(size.select(F.col("k").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b")
    score = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return sized.where(score >= jaccard).select("a", "b", "shared", F.round(score, 6).alias("jaccard"))


def cognition_pass(facts: DataFrame) -> DataFrame:
    """All mining results as (kind, subject, relation, value, confidence): prototypes, gaps, hypotheses and analogies, for review.

    None of it is a fact; nothing is written back.
    """
    none = F.lit(None).cast("string")
    parts = [
        prototypes(facts).select(F.lit("prototype").alias("kind"), F.col("example").alias("subject"), F.col("relations").alias("relation"), none.alias("value"), "confidence"),
        gaps(facts).select(F.lit("gap").alias("kind"), "subject", "relation", none.alias("value"), F.col("support").alias("confidence")),
        hypotheses(facts).select(F.lit("hypothesis").alias("kind"), "subject", "relation", "value", "confidence"),
        analogies(facts).select(F.lit("analogy").alias("kind"), F.col("a").alias("subject"), F.lit("like").alias("relation"), F.col("b").alias("value"), F.col("jaccard").alias("confidence")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
