"""Commits, branches, diff, blame and merge over fact tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.graph import ancestry

TRIPLE = ("subject", "relation", "lvalue")


def commit_id(parents: list[str], branch: str, message: str, ts: str) -> str:
    """Chain hash over the parents' ids and the commit's own fields."""
    return hashlib.sha256("\x1f".join([*parents, branch, message, ts]).encode()).hexdigest()[:32]


def new_commit(spark, parents: list[str], branch: str, message: str, ts: str, n_facts: int) -> DataFrame:
    own = commit_id(parents, branch, message, ts)
    return spark.createDataFrame([(own, parents, branch, message, n_facts)], "id string, parents array<string>, branch string, message string, n_facts int").withColumn("ts", F.lit(ts).cast("timestamp"))


def active_at(facts: DataFrame, commits: DataFrame, head: str) -> DataFrame:
    """Facts born in the history of `head` and not retired in it."""
    heads = commits.where(F.col("id") == head).select(F.col("id").alias("head"))
    seen = ancestry(commits, heads).select("id")
    born = facts.join(seen.withColumnRenamed("id", "birth_commit"), "birth_commit", "left_semi")
    return born.join(seen.withColumnRenamed("id", "retired_commit"), "retired_commit", "left_anti")


def triples_of(facts: DataFrame) -> DataFrame:
    return facts.withColumn("lvalue", F.lower("value")).select(*TRIPLE).distinct()


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Triples only in a (removed) and only in b (added)."""
    ta, tb = triples_of(a), triples_of(b)
    removed = ta.join(tb, list(TRIPLE), "left_anti").withColumn("change", F.lit("removed"))
    return removed.unionByName(tb.join(ta, list(TRIPLE), "left_anti").withColumn("change", F.lit("added")))


def common_ancestor(commits: DataFrame, a: str, b: str) -> str | None:
    """The latest commit in both histories."""
    heads = commits.where(F.col("id").isin(a, b)).select(F.col("id").alias("head"))
    both = ancestry(commits, heads).groupBy("id").agg(F.countDistinct("head").alias("n")).where(F.col("n") == (1 if a == b else 2))
    row = commits.join(both, "id").agg(F.max_by("id", F.struct("ts", "id")).alias("id")).first()
    return row["id"]


def blame(facts: DataFrame, commits: DataFrame, subject: str, relation: str) -> DataFrame:
    rows = facts.where((F.col("subject") == subject) & (F.col("relation") == relation))
    c = commits.select(F.col("id").alias("birth_commit"), "branch", "message")
    return rows.join(c, "birth_commit", "left").orderBy("tx_from", "id")


def merge(ours: DataFrame, theirs: DataFrame, base: DataFrame, strategy: str = "latest") -> DataFrame:
    """Three-way merge of active facts on (subject, relation): subject, relation, value, origin.

    A key that one side left as it was in the base takes the other side's value, or its removal.  A key that both changed takes the
    later value (strategy "latest") or keeps both ("union").  One full outer join over per-key aggregates.
    """
    key = ["subject", "relation"]

    def side(df, tag):
        latest = F.max(F.struct("valid_from", "value"))
        return df.groupBy(*key).agg(latest.alias(tag))

    joined = side(ours, "o").join(side(theirs, "t"), key, "full").join(side(base, "b"), key, "left")
    same = lambda x, y: F.col(f"{x}.value").eqNullSafe(F.col(f"{y}.value"))
    later = F.when(F.col("o").isNull(), F.col("t")).when(F.col("t").isNull(), F.col("o")).otherwise(F.greatest("o", "t"))
    origin = F.when(same("o", "t"), "both").when(same("o", "b"), "theirs").when(same("t", "b"), "ours").otherwise("conflict")
    picked = joined.withColumn("origin", origin).withColumn(
        "pick", F.when(F.col("origin").isin("both", "ours"), F.col("o")).when(F.col("origin") == "theirs", F.col("t")).otherwise(later)
    )
    one = picked.where("pick is not null").select(*key, F.col("pick.value").alias("value"), "origin")
    if strategy == "latest":
        return one
    lost = picked.where("origin = 'conflict' and o is not null and t is not null").select(*key, F.least("o", "t").alias("x")).select(*key, F.col("x.value").alias("value"), F.lit("conflict").alias("origin"))
    return one.unionByName(lost)


def branch_heads(commits: DataFrame) -> DataFrame:
    """(branch, head, n) of every branch: its latest commit, of equally late ones the greatest id."""
    return commits.groupBy("branch").agg(F.max(F.struct("ts", "id")).alias("h"), F.count(F.lit(1)).alias("n")).select("branch", F.col("h.id").alias("head"), "n")


def create_branch(heads: DataFrame, name: str, at: str) -> DataFrame:
    """The table of heads with a branch put at a commit; a branch of that name moves there."""
    own = heads.sparkSession.range(1).select(F.lit(name).alias("branch"), F.lit(at).alias("head"), F.lit(0).cast("bigint").alias("n"))
    return heads.where(F.col("branch") != name).unionByName(own)


def checkout(facts: DataFrame, commits: DataFrame, heads: DataFrame, branch: str) -> DataFrame:
    """The facts active at the head of a branch."""
    row = heads.where(F.col("branch") == branch).first()
    if row is None:
        raise KeyError(branch)
    return active_at(facts, commits, row["head"])
