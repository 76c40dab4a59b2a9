"""Facets, statistics, summaries and the memory hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def facet_counts(facts: DataFrame, field: str = "relation") -> DataFrame:
    """Active facts per value of a field, most frequent first; null and empty keys are left out."""
    return (
        facts.where(F.col("is_active") & (F.coalesce(F.col(field), F.lit("")) != ""))
        .groupBy(F.col(field).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "key")
    )


def cube_facets(facts: DataFrame, *fields: str) -> DataFrame:
    return facts.cube(*fields).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def store_stats(facts: DataFrame) -> DataFrame:
    """All store counters in one pass."""
    return facts.agg(
        F.count(F.lit(1)).alias("facts"),
        F.count_if("is_active").alias("active"),
        F.count_if(~F.col("is_active")).alias("inactive"),
        F.count_if("quarantined").alias("quarantined"),
        F.count_if("is_derived").alias("derived"),
        F.countDistinct("user_id").alias("users"),
        F.countDistinct("subject").alias("subjects"),
        F.countDistinct("relation").alias("relations"),
        F.sum("access_count").alias("accesses"),
    )


def users(facts: DataFrame) -> DataFrame:
    return facts.select("user_id").distinct()


def schema_report(facts: DataFrame) -> DataFrame:
    """Per relation: rows, share of its subjects that have a single value, first and last start."""
    per_subject = facts.groupBy("relation", "subject").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("values"), F.min("valid_from").alias("first"), F.max("valid_from").alias("last")
    )
    return per_subject.groupBy("relation").agg(
        F.sum("n").alias("n"),
        F.round(F.avg((F.col("values") == 1).cast("double")), 6).alias("single_valued"),
        F.date_format(F.min("first"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("last"), "yyyy-MM-dd").alias("last_day"),
    )


def merge_reports(reports: DataFrame, k: int = 3) -> DataFrame:
    """Histograms of many scopes added up; what fewer than the k-anonymity threshold contribute to stays out.

    A relation passes with a count of k * max(1, scopes // 4), or of 10,000, and at least k scopes.
    """
    scopes = reports.agg(F.countDistinct("user_id")).first()[0]
    merged = reports.groupBy("relation").agg(F.sum("n").alias("n"), F.countDistinct("user_id").alias("n_scopes"))
    return merged.where((F.col("n_scopes") >= k) & ((F.col("n") >= k * max(1, scopes // 4)) | (F.col("n") >= 10_000)))


def session_summaries(facts: DataFrame, least: int = 5, shown: int = 5) -> DataFrame:
    """Per (user, run) with at least `least` facts and per relation: the first values in order, and how many more."""
    per_run = facts.groupBy("user_id", "run_id", "relation").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("value")).alias("values"))
    total = F.sum("n").over(Window.partitionBy("user_id", "run_id"))
    more = F.size("values") - shown
    text = F.concat(F.array_join(F.slice("values", 1, shown), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))
    return per_run.withColumn("total", total).where(F.col("total") >= least).select("user_id", "run_id", "relation", "n", text.alias("summary"))


def day_summaries(facts: DataFrame, first: int = 3) -> DataFrame:
    """Per user and day, the first subjects and the number of facts."""
    day = F.date_format("valid_from", "yyyy-MM-dd")
    return facts.groupBy("user_id", day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.sort_array(F.collect_set("subject")), 1, first), ", ").alias("subjects")
    )


def persona(facts: DataFrame, least_access: int = 3) -> DataFrame:
    """Per user and relation the most used value; of equals the first by text."""
    used = facts.where(F.col("access_count") >= least_access).groupBy("user_id", "relation", "value").agg(F.sum("access_count").alias("uses"))
    w = Window.partitionBy("user_id", "relation").orderBy(F.col("uses").desc(), "value")
    return used.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def memory_tree(facts: DataFrame) -> DataFrame:
    """Level sizes of the hierarchy fact, session, day, user, each built from the level below."""
    level1 = facts.groupBy("user_id", F.date_format("valid_from", "yyyy-MM-dd").alias("day"), "run_id").agg(F.count(F.lit(1)).alias("facts"))
    level2 = level1.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("sessions"), F.sum("facts").alias("facts"))
    return level2.groupBy("user_id").agg(F.count(F.lit(1)).alias("days"), F.sum("sessions").alias("sessions"), F.sum("facts").alias("facts"))


def score_stats(rows: DataFrame, score: str) -> DataFrame:
    return rows.agg(F.min(score).alias("least"), F.max(score).alias("most"), F.round(F.avg(score), 6).alias("mean"))


def dedup_audit(chunks: DataFrame) -> DataFrame:
    """How much exact repetition a corpus holds."""
    per_text = chunks.groupBy(F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).alias("chars"))
    return per_text.agg(
        F.sum("copies").alias("texts"),
        F.count(F.lit(1)).alias("distinct_texts"),
        F.sum(F.col("copies") * F.col("chars")).alias("chars"),
        F.sum("chars").alias("distinct_chars"),
    ).withColumn("ratio", F.round(F.col("distinct_chars") / F.col("chars"), 6))


def accuracy(results: DataFrame, group: str, outcome: str) -> DataFrame:
    """Mean and standard deviation of an outcome per group."""
    return results.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(outcome), 6).alias("mean"), F.round(F.coalesce(F.stddev(outcome), F.lit(0.0)), 6).alias("sd")
    )


def integer_sum(facts: DataFrame, by: str = "relation") -> DataFrame:
    """Per group the number and the sum of the values that are whole numbers."""
    number = F.expr("try_cast(value AS BIGINT)")
    return facts.groupBy(by).agg(F.count(number).alias("n"), F.coalesce(F.sum(number), F.lit(0)).alias("total"))


def session_brief(facts: DataFrame, keys: tuple[str, ...] = ("user_id", "run_id")) -> DataFrame:
    """What to hand over of each session: its span, number of facts, and the last value of each relation as text, in order of relation."""
    last = facts.groupBy(*keys, "relation").agg(F.max_by("value", F.struct("tx_from", "seq")).alias("value"), F.count(F.lit(1)).alias("n"), F.min("tx_from").alias("a"), F.max("tx_from").alias("b"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("relation", "value"))), lambda x: F.concat_ws("=", x["relation"], x["value"]))
    return last.groupBy(*keys).agg(F.min("a").alias("first"), F.max("b").alias("last"), F.sum("n").alias("n"), F.array_join(lines, "; ").alias("brief"))
