"""Scans and the adapters that view the star-schema tables as facts, edges, chunks, vectors and triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions.hashing import fact_id
from lorekeep.schemas import DEFAULTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_defaults(facts: DataFrame) -> DataFrame:
    """Fill in the fact columns that a source lacks or leaves null."""
    columns = {}
    for name, value in DEFAULTS.items():
        columns[name] = F.coalesce(F.col(name), F.lit(value)) if name in facts.columns else F.lit(value)
    for name, kind in (("agent_id", "string"), ("run_id", "string"), ("valid_to", "timestamp"), ("tx_to", "timestamp"), ("source_id", "string"), ("source_hash", "string")):
        if name not in facts.columns:
            columns[name] = F.lit(None).cast(kind)
    return facts.withColumns(columns)


def event_facts(events: DataFrame) -> DataFrame:
    """events as bi-temporal facts: (user, event type, whole value) valid from the event on."""
    eid = F.col("event_id")
    return with_defaults(
        events.select(
            eid.alias("seq"),
            eid.cast("string").alias("id"),
            F.concat(F.lit("u"), F.col("user_id")).alias("subject"),
            F.col("event_type").alias("relation"),
            F.floor("value").cast("string").alias("value"),
            F.col("ts").cast("timestamp").alias("valid_from"),
            F.col("ts").cast("timestamp").alias("tx_from"),
            F.concat(F.lit("t"), F.col("user_id") % 3).alias("user_id"),
            F.when(eid % 4 == 0, F.lit("scout")).alias("agent_id"),
            F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
            (F.lit(0.5) + (eid % 50) / F.lit(100.0)).alias("confidence"),
            (eid % 25).cast("int").alias("access_count"),
            (F.lit(1) + eid % 3).cast("int").alias("reinforcement"),
            (eid % 11 != 0).alias("is_active"),
            (eid % 97 == 0).alias("quarantined"),
            F.col("props").alias("provenance"),
        )
    )


def event_edges(events: DataFrame) -> DataFrame:
    """Each event to the one before it of the same user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return (
        events.select("event_id", "ts", F.lag("event_id").over(w).alias("prior"))
        .where("prior is not null")
        .select(F.col("event_id").alias("src"), F.col("prior").alias("dst"), F.lit("TEMPORALLY_PRECEDED_BY").alias("kind"), F.col("ts").alias("created"))
    )


def document_chunks(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("user_id"), "lang")


def turn_chunks(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("position"), F.col("role").alias("agent_id"), "text"
    )


def dimension_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o) over customers, orders, nations and regions."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    tag = lambda p, c: F.concat(F.lit(p), F.col(c))
    parts = [
        orders.select(tag("o", "o_orderkey").alias("s"), F.lit("placed_by").alias("p"), tag("c", "o_custkey").alias("o")),
        customer.select(tag("c", "c_custkey"), F.lit("lives_in"), tag("n", "c_nationkey")),
        customer.select(tag("c", "c_custkey"), F.lit("segment"), F.col("c_mktsegment")),
        nation.select(tag("n", "n_nationkey"), F.lit("member_of"), tag("r", "n_regionkey")),
        nation.select(tag("n", "n_nationkey"), F.lit("name"), F.col("n_name")),
        region.select(tag("r", "r_regionkey"), F.lit("name"), F.col("r_name")),
    ]
    return reduce(DataFrame.unionAll, parts)


def normalise_messages(messages: DataFrame) -> DataFrame:
    """Messages as rows of role and text: blocks of multi-part contents joined, blanks dropped."""
    kind = dict(messages.dtypes)["content"]
    text = F.array_join(F.transform("content", lambda b: b["text"]), " ") if kind.startswith("array<struct") else F.col("content")
    role = F.coalesce(F.col("role"), F.lit("user")) if "role" in messages.columns else F.lit("user")
    return messages.withColumn("text", F.trim(text)).withColumn("role", role).drop("content").where("text <> ''")


def scope_filter(df: DataFrame, user_id: str | None, agent_id: str | None = None, run_id: str | None = None) -> DataFrame:
    """Rows a caller may see.  A user's query sees rows without an agent, an agent's sees those and its own; no user, no rows."""
    if user_id is None:
        return df.limit(0)
    seen: Column = (F.col("user_id") == user_id) & (
        F.col("agent_id").isNull() if agent_id is None else F.col("agent_id").isNull() | (F.col("agent_id") == agent_id)
    )
    return df.where(seen if run_id is None else seen & (F.col("run_id") == run_id))


def query_facts(
    facts: DataFrame,
    *,
    active: bool | None = True,
    include_quarantined: bool = False,
    derived: bool | None = None,
    branch_ids: DataFrame | None = None,
    order: str = "valid_from",
    limit: int | None = None,
    **equal: str | None,
) -> DataFrame:
    """Facts by equality on any of subject, relation, value, user_id, agent_id, run_id.

    `active` other than True removes the filter.  `branch_ids` is a frame of the ids active on a branch.
    """
    tests = [F.col(name) == value for name, value in equal.items() if value is not None]
    if active is True:
        tests.append(F.col("is_active"))
    if not include_quarantined:
        tests.append(~F.col("quarantined"))
    if derived is not None:
        tests.append(F.col("is_derived") == derived)
    out = facts.where(reduce(lambda a, b: a & b, tests)) if tests else facts
    if branch_ids is not None:
        out = out.join(branch_ids, "id", "left_semi")
    out = out.orderBy(order, "id")
    return out if limit is None else out.limit(limit)


def get_facts(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Point lookups in bulk: a semi join, whatever the number of ids."""
    return facts.join(ids.select("id"), "id", "left_semi")


def facts_of_chunk(facts: DataFrame, chunk_id: str, active_only: bool = True) -> DataFrame:
    out = facts.where(F.col("source_id") == chunk_id)
    return out.where("is_active") if active_only else out


def kv_prefix(kv: DataFrame, prefix: str) -> DataFrame:
    return kv.where(F.col("key").startswith(prefix)).orderBy("key")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest row per key over both tables: INSERT OR REPLACE for edges, chunks, negations and key-value pairs."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return current.unionByName(changes).withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def with_fact_ids(facts: DataFrame) -> DataFrame:
    """Deterministic ids; rows of equal content get an occurrence number."""
    base = facts.withColumn("__fid", fact_id())
    w = Window.partitionBy("__fid").orderBy("tx_from", "source_id")
    n = F.row_number().over(w)
    return base.withColumn("id", F.when(n == 1, F.col("__fid")).otherwise(F.concat(F.col("__fid"), F.lit("-"), n))).drop("__fid")
