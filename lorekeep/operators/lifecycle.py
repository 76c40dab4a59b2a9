"""Truth maintenance and consolidation in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.scoring import fade, retention
from lorekeep.functions.text import similarity

SINGLE_VALUED = ("works_at", "lives_in", "name", "role", "birthday", "reports_to", "favorite", "email", "phone", "status")
CANONICAL = {"employer": "works_at", "employed_at": "works_at", "resides_in": "lives_in", "located_in": "lives_in", "job": "role", "title": "role", "boss": "reports_to", "manager": "reports_to", "fond_of": "likes", "enjoys": "likes", "hates": "dislikes"}


def canonical_relation(relation: Column) -> Column:
    pairs = [F.lit(x) for kv in CANONICAL.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.lower(relation)], F.lower(relation))


def decide(facts: DataFrame, single_valued: tuple[str, ...] = SINGLE_VALUED, keys: tuple[str, ...] = ("subject", "relation"), order: tuple[str, ...] = ("valid_from", "seq"), merge_at: float = 0.92) -> DataFrame:
    """What each fact does to the one before it of its key: COMMIT, SKIP, MERGE, SUPERSEDE or COEXIST.

    Exact against the sequential process as long as nothing merges into an earlier value than the last; the streaming
    processor carries the whole value set and decides those too.
    """
    before = F.lag("value").over(Window.partitionBy(*keys).orderBy(*order))
    d = facts.withColumn("before", before)
    equal = F.lower(F.trim("before")) == F.lower(F.trim("value"))
    return d.withColumn(
        "decision",
        F.when(F.col("before").isNull(), "COMMIT")
        .when(equal, "SKIP")
        .when(F.col("relation") == "mentioned", "COEXIST")
        .when(similarity(F.col("before"), F.col("value")) >= merge_at, "MERGE")
        .when(F.col("relation").isin(*single_valued), "SUPERSEDE")
        .otherwise("COEXIST"),
    )


def retract(facts: DataFrame, retractions: DataFrame, least: float = 0.6) -> DataFrame:
    """Open intervals closed by a retraction of the same subject and relation whose value is similar enough."""
    r = retractions.select(F.col("subject").alias("rs"), F.col("relation").alias("rr"), F.col("value").alias("rv"), F.col("valid_from").alias("ended"))
    hit = facts.where("valid_to is null").join(r, (F.col("subject") == F.col("rs")) & (F.col("relation") == F.col("rr")) & (F.col("ended") >= F.col("valid_from")))
    closed = hit.where(similarity(F.col("value"), F.col("rv")) >= least).groupBy("id").agg(F.min("ended").alias("ended"))
    joined = facts.join(closed, "id", "left")
    return joined.withColumn("valid_to", F.coalesce("valid_to", "ended")).withColumn("is_active", F.col("is_active") & F.col("ended").isNull()).drop("ended")


def consolidate_types(facts: DataFrame, now: str, promote: float = 1.0, demote: float = 0.2) -> DataFrame:
    """memory_type by retention: promoted to long term, demoted to archive, else as it is."""
    score = retention(now)
    kind = F.when(score >= promote, "long_term").when(score < demote, "archive").otherwise(F.col("memory_type"))
    return facts.withColumn("memory_type", kind)


def fade_clusters(facts: DataFrame, now: str, forget: float = 0.10, cluster: float = 0.30) -> DataFrame:
    """id, action: forgotten below `forget`; in a (subject, relation, normalised value) cluster whose members all score under `cluster`, all but the best are merged away."""
    scored = facts.withColumn("score", fade(now))
    w = Window.partitionBy("subject", "relation", F.lower(F.trim("value")))
    best = F.row_number().over(w.orderBy(F.col("score").desc(), "seq"))
    marked = scored.withColumn("top", F.max("score").over(w)).withColumn("members", F.count(F.lit(1)).over(w)).withColumn("place", best)
    action = F.when(F.col("score") < forget, "forget").when((F.col("members") > 1) & (F.col("top") < cluster) & (F.col("place") > 1), "merge").otherwise("keep")
    return marked.select("seq", action.alias("action"))


def retire(facts: DataFrame, now: str, days: int = 365) -> DataFrame:
    """Ended long ago and never used."""
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    gone = (F.col("valid_to") < cutoff) & (F.col("access_count") == 0)
    return facts.withColumn("is_active", F.col("is_active") & ~F.coalesce(gone, F.lit(False)))


def edit(facts: DataFrame, fact_id: str, **changes) -> DataFrame:
    """A fact's fields replaced, with the edit noted in its provenance map."""
    out, hit = facts, F.col("id") == fact_id
    for name, value in changes.items():
        out = out.withColumn(name, F.when(hit, F.lit(value)).otherwise(F.col(name)))
    if "provenance" in facts.columns and dict(facts.dtypes)["provenance"].startswith("map"):
        noted = F.map_concat(F.map_filter("provenance", lambda k, _: k != "edited"), F.create_map(F.lit("edited"), F.lit(",".join(sorted(changes)))))
        out = out.withColumn("provenance", F.when(hit, noted).otherwise(F.col("provenance")))
    return out


def assess(facts: DataFrame, single_valued: tuple[str, ...] = SINGLE_VALUED, keys: tuple[str, ...] = ("subject", "relation"), order: tuple[str, ...] = ("valid_from", "seq"), recent: int = 8) -> DataFrame:
    """`decide`, with the interference a fact causes and whether it needs an audit.

    Interference is 1 where it merges, its similarity to the value it supersedes, its greatest similarity to the `recent`
    values it comes to stand beside, else 0; a superseding fact of little confidence and much interference is flagged.
    """
    d = decide(facts, single_valued, keys, order)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-recent, -1)
    near = F.array_max(F.transform("earlier", lambda v: similarity(v, F.col("value"))))
    score = (
        F.when(F.col("decision") == "MERGE", 1.0)
        .when(F.col("decision") == "SUPERSEDE", similarity(F.col("before"), F.col("value")))
        .when((F.col("decision") == "COEXIST") & (F.col("relation") != "mentioned"), F.coalesce(near, F.lit(0.0)))
        .otherwise(0.0)
    )
    out = d.withColumn("earlier", F.collect_list("value").over(w)).withColumn("interference", F.round(score, 6)).drop("earlier")
    return out.withColumn("audit", (F.col("decision") == "SUPERSEDE") & (F.col("interference") > 0.75) & (F.col("confidence") < 0.6))


def overlap_gate(new: DataFrame, known: DataFrame, limit: float = 0.9, least: int = 10) -> DataFrame:
    """New vectors (id, embedding) with the nearest known one and whether they are worth adding: those nearer than `limit` to it
    are not, once `least` vectors are known."""
    from lorekeep.operators.vectors import search_many

    if known.count() < least:
        return new.select("id", F.lit(None).cast("double").alias("nearest"), F.lit(True).alias("added"))
    best = search_many(known, new.select(F.col("id").alias("query"), "embedding"), 1).select(F.col("query").alias("q"), F.col("score").alias("nearest"))
    return new.select("id").join(best, F.col("id") == F.col("q"), "left").select("id", "nearest", (F.coalesce("nearest", F.lit(-1.0)) <= limit).alias("added"))


def bump_access(facts: DataFrame, accesses: DataFrame) -> DataFrame:
    """Access counts raised by a log of accesses (id): the log is counted first, so a hot fact is one row per task."""
    seen = accesses.groupBy(F.col("id").alias("a_id")).agg(F.count(F.lit(1)).alias("a_n"))
    return facts.join(seen, F.col("id") == F.col("a_id"), "left").withColumn("access_count", (F.col("access_count") + F.coalesce("a_n", F.lit(0))).cast("int")).drop("a_id", "a_n")


def provenance_has(facts: DataFrame, key: str, value: str) -> DataFrame:
    """Facts whose provenance (JSON) holds this value under the key: parsed, so that no other field's text can match."""
    return facts.where(F.get_json_object("provenance", f"$.{key}") == value)
