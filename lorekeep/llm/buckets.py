"""Pairs of one bucket's members that lie in different components, without all pairs of a bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a bucket are compared in blocks of this many.
BLOCK = 256


def crossing_cells(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides (band, x, y, node, component, rest) whose join on (band, x, y) meets every pair of one bucket's
    members in different components, by rows of (band, node, component).

    One side holds the members outside the bucket's largest component, the other all members; both are cut into blocks
    of BLOCK, and a row goes to each block of the other side.  A bucket that is one component but for a few strangers so
    makes rows in proportion to its members.  Two members outside the largest component meet twice (both have `rest`).
    Of components of one size the greatest name counts as the largest; an empty table gives empty sides.
    """
    groups = labelled.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    table = (
        groups.groupBy("band")
        .agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("size"))
        .where("size > most.n")
        .select("band", F.col("most.component").alias("main"), F.ceil((F.col("size") - F.col("most.n")) / BLOCK).cast("int").alias("xs"), F.ceil(F.col("size") / BLOCK).cast("int").alias("ys"))
    )
    rows = labelled.join(table, "band").withColumn("rest", F.col("component") != F.col("main"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("rest").select("band", block("xs").alias("x"), every("ys").alias("y"), "node", "component", "rest")
    right = rows.select("band", every("xs").alias("x"), block("ys").alias("y"), "node", "component", "rest")
    return left, right
