"""Connected components by distributed union-find: hooking to the least neighbour label, then pointer jumping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import free, materialise


def connected_components(links: DataFrame, a: str = "a", b: str = "b", write: Callable[[DataFrame, str], DataFrame] = materialise) -> DataFrame:
    """(node, component) for every node of a link; component is the least node reachable.

    Each round, every root hooks onto the least root among its trees' neighbours, and all nodes jump to their root's
    root, so trees merge in pairs at least and the number of rounds grows with the logarithm of the component size.
    Least labels are aggregates that combine before the shuffle, so a hub with many links is no single task's load.
    Rounds end when no link joins two labels.  Each round is written to the shared folder, by `write`, and the tables of the
    round before are deleted.

    Links with a null end are left out; repeated links and links of a node with itself add nothing; an empty table gives
    an empty result; other columns are never read.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")  # null ends aren't unequal
    both = write(both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-links")
    label = both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("component"))
    written = label = write(label, "cc-0")
    for step in range(1, 64):
        parent = label.select(F.col("node").alias("p"), F.col("component").alias("grand"))
        while True:  # jump until every node points at a root
            jumped = write(
                label.join(parent, label["component"] == parent["p"]).select("node", F.col("grand").alias("component"), (F.col("grand") != F.col("component")).alias("moved")),
                f"cc-jump-{step}",
            )
            moved = not jumped.where("moved").isEmpty()
            free(written)
            written, label = jumped, jumped.select("node", "component")
            if not moved:
                break
            parent = label.select(F.col("node").alias("p"), F.col("component").alias("grand"))
        crossing = (
            both.join(label.withColumnsRenamed({"node": "u", "component": "cu"}), "u")
            .join(label.withColumnsRenamed({"node": "v", "component": "cv"}), "v")
            .where("cu <> cv")
            .groupBy("cu")
            .agg(F.min("cv").alias("cv"))
            .where("cv < cu")
        )
        hooks = write(crossing, f"cc-hooks-{step}")
        if hooks.isEmpty():
            free(both, hooks)
            return label
        joined = write(
            label.join(hooks, label["component"] == hooks["cu"], "left").select("node", F.coalesce("cv", "component").alias("component")), f"cc-{step}"
        )
        free(written, hooks)
        written = label = joined
    raise RuntimeError("components did not settle")
