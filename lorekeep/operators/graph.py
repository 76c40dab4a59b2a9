"""Graph operators: chains, hops, walks, personalised PageRank, closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.scratch import materialise


def causal_chain(edges: DataFrame, start: DataFrame, direction: str = "ancestors", max_depth: int = 8) -> DataFrame:
    """(start, node, depth) reachable along the edges, each node at its least depth.

    Where every node has one edge at most, a start has one path, which grows by one join per level.  Elsewhere the frontier grows
    by what isn't there yet, one join and one table per level; a cycle ends at a level without new nodes.
    `start` has a column `start`.
    """
    step = edges.select(F.col("src").alias("f"), F.col("dst").alias("t")) if direction == "ancestors" else edges.select(F.col("dst").alias("f"), F.col("src").alias("t"))
    step = materialise(step.distinct(), "chain-steps")
    if step.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.count("t").alias("known")).where("n > 1 OR known < n").isEmpty():
        return _paths(step, start, max_depth)
    frontier = start.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    found = frontier
    for depth in range(1, max_depth + 1):
        after = frontier.join(step, F.col("node") == F.col("f")).select("start", F.col("t").alias("node"), F.lit(depth).alias("depth")).distinct()
        frontier = materialise(after.join(found.select("start", "node"), ["start", "node"], "left_anti"), "chain")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found.where("depth > 0").groupBy("start", "node").agg(F.min("depth").alias("depth"))


def _paths(step: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """`causal_chain` where each node has one next node: a row a start, with the nodes on its way in order."""
    rows = start.select("start", F.array(F.col("start").cast(step.schema["t"].dataType)).alias("path")).distinct()
    for depth in range(1, max_depth + 1):
        met = rows.join(step, F.element_at("path", -1) == F.col("f"), "left")
        rows = met.select("start", F.when(F.col("t").isNull(), F.col("path")).otherwise(F.concat("path", F.array("t"))).alias("path"))
        if depth % 8 == 0 and depth < max_depth:
            rows = materialise(rows, "chain")
            if rows.where(F.size("path") > depth).isEmpty():
                break
    # on a cycle all that follows the first repeated node is a repetition
    return rows.select("start", F.posexplode(F.array_distinct("path")).alias("depth", "node")).where("depth > 0").select("start", "node", "depth")


def structural_query(facts: DataFrame, start: DataFrame, chain: list[str], least: float = 0.0) -> DataFrame:
    """Follow relations hop by hop: per start the best fact by (confidence, valid_from, value), confidences multiplied.

    A start whose chain breaks, or whose confidence falls under `least`, has no row.
    """
    at = start.select("start", F.col("start").alias("at"), F.lit(1.0).alias("confidence"))
    for relation in chain:
        hop = facts.where(F.col("relation") == relation).select(F.col("subject").alias("s"), F.col("value").alias("v"), F.col("confidence").alias("c"), "valid_from")
        best = at.join(hop, F.col("at") == F.col("s")).groupBy("start", "confidence").agg(F.max(F.struct("c", "valid_from", "v")).alias("b"))
        at = best.select("start", F.col("b.v").alias("at"), (F.col("confidence") * F.col("b.c")).alias("confidence"))
    return at.where(F.col("confidence") >= least).select("start", F.col("at").alias("answer"), F.round("confidence", 6).alias("confidence"))


def multi_hop_chain(facts: DataFrame, start: DataFrame, relation: str, depth: int) -> DataFrame:
    return structural_query(facts, start, [relation] * depth)


def same_relation_pairs(facts: DataFrame, most: int = 5) -> DataFrame:
    """relation o relation: value of one fact is the subject of another of the same relation; at most five a row."""
    a = facts.select("relation", F.col("subject").alias("first"), F.col("value").alias("middle"))
    b = facts.select("relation", F.col("subject").alias("middle"), F.col("value").alias("last"))
    w = Window.partitionBy("relation", "first", "middle").orderBy("last")
    return a.join(b, ["relation", "middle"]).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def bipartite_edges(facts: DataFrame) -> DataFrame:
    """Undirected entity-fact edges (u, v), with multi-edges."""
    fact = F.concat(F.lit("f:"), F.col("id"))
    ends = facts.select(F.concat(F.lit("e:"), F.lower("subject")).alias("u"), fact.alias("v")).unionAll(
        facts.select(F.concat(F.lit("e:"), F.lower("value")), fact)
    )
    return ends.unionAll(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = 12, damping: float = 0.85) -> DataFrame:
    """(node, rank) after `rounds` rounds with teleport to the seeds only; nodes without rank are left out.

    A round is one join on the co-partitioned edge table and one aggregate.  The lineage is cut every fourth round.
    """
    degree = edges.groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
    out = materialise(edges.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).join(degree, "u").select("u", "v", (F.col("n") / F.col("degree")).alias("share")), "ppr-edges")
    n = seeds.count()
    home = seeds.select("node", F.lit(1.0 / max(1, n)).alias("home"))
    rank = home.withColumnRenamed("home", "rank")
    for i in range(rounds):
        moved = rank.join(out, F.col("node") == F.col("u")).groupBy("v").agg(F.sum(F.col("rank") * F.col("share")).alias("moved"))
        rank = moved.join(home, F.col("v") == F.col("node"), "full").select(
            F.coalesce("v", "node").alias("node"),
            (damping * F.coalesce("moved", F.lit(0.0)) + (1 - damping) * F.coalesce("home", F.lit(0.0))).alias("rank"),
        )
        if i % 4 == 3 and i + 1 < rounds:
            rank = materialise(rank, "ppr-rank")
    return rank


def entity_walk(facts: DataFrame, query_tokens: list[str], most: int = 64) -> DataFrame:
    """Facts by tokens: 1 per distinct query token in subject or value, and 0.5 for facts that share an entity token with those."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "subject", "value")), F.lit("[a-z0-9]+"), F.lit(0)))
    index = facts.select("id", F.explode(tokens).alias("token"))
    first = index.where(F.col("token").isin(query_tokens)).groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    near_tokens = index.join(first.select("id"), "id", "left_semi").select("token").distinct()
    second = index.join(near_tokens, "token", "left_semi").select("id").distinct().join(first.select("id"), "id", "left_anti").withColumn("score", F.lit(0.5))
    return first.unionByName(second.orderBy("id").limit(most))


def ancestry(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, id) of each head and all its ancestors.

    Distances are doubled: what is reached within 2^k steps, and each commit's ancestors at exactly 2^k, give both for
    2^(k+1), so a history of n commits takes log n rounds.
    """
    jump = commits.select("id", F.explode("parents").alias("to"))
    found, n = heads.select("head", F.col("head").alias("id")), -1
    while True:
        further = found.join(jump, "id").select("head", F.col("to").alias("id"))
        found = materialise(found.unionByName(further).distinct(), "ancestry")
        now = found.count()
        if now == n:
            return found
        n = now
        jump = materialise(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("beyond")), "to").select("id", F.col("beyond").alias("to")).distinct(), "ancestry-jump")


def commit_log(commits: DataFrame, head: str, limit: int) -> DataFrame:
    """The `limit` commits nearest to a head (fewest steps, then latest), nearest first.

    Distances are doubled as in `ancestry`, and no further than until `limit` commits are known at their least distance.
    """
    jump = commits.select("id", F.explode("parents").alias("to"))
    found, reach = commits.where(F.col("id") == head).select("id", F.lit(0).alias("depth")), 1
    n = -1
    while True:
        further = found.join(jump, "id").select(F.col("to").alias("id"), (F.col("depth") + reach).alias("depth"))
        found = materialise(found.unionByName(further).groupBy("id").agg(F.min("depth").alias("depth")), "log")
        now, near = found.agg(F.count(F.lit(1)), F.count_if(F.col("depth") < 2 * reach)).first()
        if now == n or near >= limit:
            return commits.join(found, "id").orderBy("depth", F.col("ts").desc(), "id").limit(limit).drop("depth")
        n, reach = now, 2 * reach
        jump = materialise(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("beyond")), "to").select("id", F.col("beyond").alias("to")).distinct(), "log-jump")


def edges_within(edges: DataFrame, ids: DataFrame, kind: str | None = None) -> DataFrame:
    """Edges with both ends in a set of ids."""
    rows = edges if kind is None else edges.where(F.col("kind") == kind)
    return rows.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def adjacent(edges: DataFrame, node, direction: str = "both") -> DataFrame:
    out, back = edges.where(F.col("src") == node), edges.where(F.col("dst") == node)
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def coherence(facts: DataFrame, window_days: int = 30, cap: int = 5) -> DataFrame:
    """Per fact, how many others within the window share an entity token, up to `cap`, as a share of it.

    As counts beyond `cap` don't matter, a (token, day) with more facts than that only says so: any fact that looks there has
    reached the cap.  The others list their facts, `cap` at most.  So a token that stands in every fact costs as much as a rare
    one, and no list grows with the table.
    """
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "subject", "value")), F.lit("[a-z0-9]+"), F.lit(0)))
    day = F.datediff("valid_from", F.lit("1970-01-01").cast("date"))
    rows = facts.select("id", day.alias("day"), F.explode(tokens).alias("token"))
    counts = rows.groupBy("token", "day").agg(F.count(F.lit(1)).alias("n"))
    few = counts.where(F.col("n") <= cap).select("token", "day")
    listed = rows.join(few, ["token", "day"]).groupBy("token", "day").agg(F.collect_list("id").alias("ids"))  # `cap` at most
    full = counts.where(F.col("n") > cap).select("token", "day", F.lit(None).cast(dict(listed.dtypes)["ids"]).alias("ids"))
    around = F.explode(F.sequence(F.col("day") - window_days, F.col("day") + window_days))
    wide = listed.unionByName(full).select("token", around.alias("day"), "ids")
    seen = wide.groupBy("token", "day").agg(F.bool_or(F.col("ids").isNull()).alias("full"), F.flatten(F.collect_list("ids")).alias("ids"))
    found = rows.join(seen, ["token", "day"]).groupBy("id").agg(F.bool_or("full").alias("full"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    n = F.when(F.col("full"), F.lit(cap)).otherwise(F.size(F.filter("ids", lambda x: x != F.col("id"))))
    return facts.select(F.col("id").alias("f_id")).join(found, F.col("f_id") == F.col("id"), "left").select(
        F.col("f_id").alias("id"), F.round(F.least(F.coalesce(n, F.lit(0)), F.lit(cap)) / F.lit(float(cap)), 6).alias("coherence")
    )


def history_closure(edges: DataFrame, start: DataFrame, kind: str = "CONTRADICTS") -> DataFrame:
    """(start, id) of all facts that edges of a kind connect to each start, in either direction, itself included.

    Reach doubles each round: what is known to be connected is joined with itself, so a chain of n edges takes log n rounds.
    """
    some = edges.where(F.col("kind") == kind).select("src", "dst")
    both = materialise(some.unionAll(some.select("dst", "src")).distinct(), "closure-edges")
    found, n = materialise(start.select("start", F.col("start").alias("id")).distinct(), "closure"), -1
    jump = both.select(F.col("src").alias("id"), F.col("dst").alias("to"))
    while True:
        found = materialise(found.unionByName(found.join(jump, "id").select("start", F.col("to").alias("id"))).distinct(), "closure")
        now = found.count()
        if now == n:
            return found
        n = now
