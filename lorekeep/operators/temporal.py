"""Bi-temporal operators: interval windows, as-of state, supersession chains, ordered-group windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Appended to every order, so that ties have one answer.
CONTENT_KEY = ("subject", "relation", "value", "valid_from")


def close_intervals(facts: DataFrame, keys: tuple[str, ...] = ("subject", "relation"), order: tuple[str, ...] = ("valid_from", "seq")) -> DataFrame:
    """valid_to = the start of the next fact of the same key; the last stays open."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return facts.withColumn("valid_to", F.lead("valid_from").over(w))


def supersession_chain(facts: DataFrame, keys: tuple[str, ...] = ("subject", "relation"), order: tuple[str, ...] = ("valid_from", "seq")) -> DataFrame:
    """Each fact's place in its chain: version (from 1), status CURRENT or SUPERSEDED, predecessor, and length of the chain."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return close_intervals(facts, keys, order).withColumns(
        {
            "version": F.row_number().over(w),
            "predecessor": F.lag("id").over(w),
            "chain_length": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
            "status": F.when(F.col("valid_to").isNull(), "CURRENT").otherwise("SUPERSEDED"),
        }
    )


def temporal_window(facts: DataFrame, start: str, end: str, field: str = "valid", active: bool = True, strict: bool = False) -> DataFrame:
    """field "valid": intervals that overlap [start, end].  field "tx": facts recorded in it, the end day included unless `strict`."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    if field == "valid":
        hit = (F.col("valid_to").isNull() | (F.col("valid_to") >= lo)) & (F.col("valid_from") <= hi)
    elif strict:
        hit = F.col("tx_from").between(lo, hi)
    else:
        hit = (F.col("tx_from") >= lo) & (F.col("tx_from") < hi + F.expr("INTERVAL 1 DAY"))
    return facts.where(hit & F.col("is_active") if active else hit)


def get_between(facts: DataFrame, start: str, end: str) -> DataFrame:
    return temporal_window(facts, start, end, active=False)


def get_before(facts: DataFrame, end: str) -> DataFrame:
    return get_between(facts, "1970-01-01", end)


def get_after(facts: DataFrame, start: str) -> DataFrame:
    return get_between(facts, start, "9999-12-31")


def state_at(facts: DataFrame, when: str, limit: int | None = 500) -> DataFrame:
    """What was believed at `when`, newest first."""
    t = F.lit(when).cast("timestamp")
    seen = (F.col("tx_from") <= t) & (F.col("tx_to").isNull() | (F.col("tx_to") > t)) & ~F.col("quarantined")
    out = facts.where(seen).orderBy(F.col("valid_from").desc(), *CONTENT_KEY[:3], "id")
    return out if limit is None else out.limit(limit)


def as_of(facts: DataFrame, when: str, keys: tuple[str, ...] = ("subject", "relation"), order: tuple[str, ...] = ("valid_from", "seq")) -> DataFrame:
    """The one current fact per key at `when`: of those begun by then, the last.

    An aggregate over structs, so each task sends one row per key instead of sorting whole histories.
    """
    t = F.lit(when).cast("timestamp")
    columns = [c for c in facts.columns if c not in keys]
    latest = F.max_by(F.struct(*columns), F.struct(*order))
    return facts.where(F.col("valid_from") <= t).groupBy(*keys).agg(latest.alias("__f")).select(*keys, "__f.*")


def facts_about(facts: DataFrame, entity: str) -> DataFrame:
    return facts.where((F.col("subject") == entity) | (F.col("value") == entity))


def history_of(facts: DataFrame, subject: str, relation: str, include_inactive: bool = True) -> DataFrame:
    out = facts.where((F.col("subject") == subject) & (F.col("relation") == relation))
    return (out if include_inactive else out.where("is_active")).orderBy("valid_from", "tx_from", "id")


def change_counts(facts: DataFrame, keys: tuple[str, ...] = ("subject", "relation")) -> DataFrame:
    """How many values a key has had and how often it changed."""
    return facts.groupBy(*keys).agg(F.countDistinct("value").alias("n_values")).withColumn("n_changes", F.col("n_values") - 1)


def numeric_range(facts: DataFrame, low: float | None = None, high: float | None = None, relation: str | None = None, k: int = 100) -> DataFrame:
    """Facts by the number in their text value, text that is none counting as 0, in order of number."""
    number = F.coalesce(F.expr("try_cast(value AS DOUBLE)"), F.lit(0.0))
    out = facts.withColumn("number", number)
    if relation is not None:
        out = out.where(F.col("relation") == relation)
    if low is not None:
        out = out.where(F.col("number") >= low)
    if high is not None:
        out = out.where(F.col("number") <= high)
    return out.orderBy("number", "seq").limit(k)


def precedence_edges(facts: DataFrame, keys: tuple[str, ...] = ("subject",), order: tuple[str, ...] = ("valid_from", "seq")) -> DataFrame:
    """Edge from each fact to the one before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (
        facts.select(F.col("id").alias("src"), F.lag("id").over(w).alias("dst"))
        .where("dst is not null")
        .withColumn("kind", F.lit("TEMPORALLY_PRECEDED_BY"))
    )


def latest(facts: DataFrame, n: int) -> DataFrame:
    return facts.orderBy(F.col("tx_from").desc(), F.col("seq").desc()).limit(n)


def diversify(ranked: DataFrame, k: int, per_relation: int = 4) -> DataFrame:
    """The first k of a ranking in which a relation's rows beyond the fourth come after all others."""
    w = Window.partitionBy("relation").orderBy("rank")
    over = (F.row_number().over(w) > per_relation).cast("int")
    return ranked.withColumn("overflow", over).orderBy("overflow", "rank").limit(k)


def step_numbers(rows: DataFrame, scope: str, order: tuple[str, ...]) -> DataFrame:
    return rows.withColumn("step", F.row_number().over(Window.partitionBy(scope).orderBy(*order)))


def daily_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy(F.window("valid_from", "1 day").alias("w"), "relation").agg(F.count(F.lit(1)).alias("n")).select(
        F.date_format("w.start", "yyyy-MM-dd").alias("day"), "relation", "n"
    )


def gap_sessions(facts: DataFrame, key: str = "subject", gap: str = "6 hours") -> DataFrame:
    """Runs of facts of a key with no pause of `gap`."""
    return (
        facts.groupBy(key, F.session_window("valid_from", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("valid_from").alias("first"), F.max("valid_from").alias("last"))
        .drop("w")
    )


def co_access(facts: DataFrame, ahead: int = 4, key: str = "subject", item: str = "relation") -> DataFrame:
    """Pairs of an item and each of the next `ahead` items of its key's sequence, with their number."""
    w = Window.partitionBy(key).orderBy("valid_from", "seq")
    leads = F.array(*[F.lead(item, i).over(w) for i in range(1, ahead + 1)])
    pairs = facts.select(F.col(item).alias("a"), leads.alias("ahead")).select("a", F.explode("ahead").alias("b")).where("b is not null")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def valid_while(facts: DataFrame, relation: str, value: str, keys: tuple[str, ...] = ("user_id", "subject")) -> DataFrame:
    """Facts of a subject whose interval overlaps one in which it stood in `relation` to `value` (any case), each once.

    The anchors of a subject are few, so the range test runs inside an equality join on the subject.
    """
    anchor = facts.where((F.col("relation") == relation) & (F.lower("value") == value.lower())).select(
        *[F.col(k).alias(f"a_{k}") for k in keys], F.col("valid_from").alias("a_from"), F.col("valid_to").alias("a_to")
    )
    same = [F.col(k) == F.col(f"a_{k}") for k in keys]
    overlap = (F.col("a_to").isNull() | (F.col("valid_from") < F.col("a_to"))) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("a_from")))
    others = facts.where(F.col("relation") != relation)
    test = overlap
    for s in same:
        test = test & s
    return others.join(anchor, test, "left_semi")


def trajectory(facts: DataFrame, keys: tuple[str, ...] = ("user_id", "run_id")) -> DataFrame:
    """The steps of each session in the order they were recorded, numbered from 1, with what stood before in the same place."""
    w = Window.partitionBy(*keys).orderBy("tx_from", "seq")
    place = Window.partitionBy(*keys, "subject", "relation").orderBy("tx_from", "seq")
    return facts.withColumn("step", F.row_number().over(w)).withColumn("previous", F.lag("value").over(place))


def best_by_overlap(groups: DataFrame, events: DataFrame, key: str = "key", words: str = "words") -> DataFrame:
    """Per group of keywords the event that shares most words with it, of equals the least id: key, id, shared.

    Words meet through an inverted index; the choice is an aggregate, so no group is sorted.
    """
    asked = groups.select(key, F.explode(F.array_distinct(words)).alias("w"))
    said = events.select("id", F.explode(F.array_distinct(words)).alias("w"))
    shared = asked.join(said, "w").groupBy(key, "id").agg(F.count(F.lit(1)).alias("shared"))
    return shared.groupBy(key).agg(F.min(F.struct((-F.col("shared")).alias("n"), "id")).alias("b")).select(key, F.col("b.id").alias("id"), (-F.col("b.n")).alias("shared"))
