"""A facade over the operators: tables in, DataFrames out."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import aggregates, extraction, governance, lifecycle, temporal
from lorekeep.plans import planner, sparql
from lorekeep.scratch import materialise
from lorekeep.sources.tables import scope_filter, with_defaults, with_fact_ids


class Memory:
    """Facts and source texts of many users.

    The tables are DataFrames and never change in place: `add` and the maintenance calls set new ones.  Persist them
    with `snapshot` from `lorekeep.sources.importers` or any sink.
    """

    def __init__(self, spark: SparkSession, facts: DataFrame | None = None, chunks: DataFrame | None = None):
        self.spark = spark
        self.facts = facts
        self.chunks = chunks

    def add(self, messages: DataFrame) -> DataFrame:
        """Extract facts from messages (id, text, user_id, ts), close superseded intervals, and return the new facts."""
        found = extraction.dedup_candidates(extraction.extract(messages, gist=False).withColumn("user_id", F.col("subject")))
        said = found.where("NOT retraction").select("user_id", "subject", "relation", "value", "confidence", "source_id", F.coalesce(F.to_timestamp("at"), F.col("ts")).alias("valid_from"), F.col("ts").alias("tx_from"))
        # written, so that the numbers are fixed and plans don't grow with every call
        start = 0 if self.facts is None else (self.facts.agg(F.max("seq")).first()[0] or 0) + 1
        new = materialise(with_fact_ids(with_defaults(said)).withColumn("seq", F.monotonically_increasing_id() + start), "memory-new")
        known = new if self.facts is None else self.facts.unionByName(new, allowMissingColumns=True)
        single = known.where(F.col("relation").isin(*lifecycle.SINGLE_VALUED))
        closed = temporal.close_intervals(single, ("user_id", "subject", "relation"), ("valid_from", "tx_from", "id")).withColumn("is_active", F.col("is_active") & F.col("valid_to").isNull())
        known = closed.unionByName(known.where(~F.col("relation").isin(*lifecycle.SINGLE_VALUED)))
        gone = found.where("retraction").select("subject", "relation", "value", F.coalesce(F.to_timestamp("at"), F.col("ts")).alias("valid_from"))
        self.facts = materialise(lifecycle.retract(known, gone), "memory-facts")
        own = messages.select("id", "text", "user_id", "ts")
        self.chunks = own if self.chunks is None else self.chunks.unionByName(own)
        return new

    def search(self, query: str, user_id: str, agent_id: str | None = None, k: int = 10, today: date | None = None) -> DataFrame:
        return planner.search(self.facts, query, user_id, agent_id, k, today)

    def get_all(self, user_id: str) -> DataFrame:
        """The user's active facts with their source texts."""
        mine = scope_filter(self.facts, user_id).where("is_active")
        return mine.join(self.chunks.select(F.col("id").alias("source_id"), F.col("text").alias("source_text")), "source_id", "left")

    def state_at(self, when: str, user_id: str) -> DataFrame:
        return temporal.state_at(scope_filter(self.facts, user_id), when)

    def history(self, user_id: str, subject: str, relation: str) -> DataFrame:
        return temporal.history_of(scope_filter(self.facts, user_id), subject, relation)

    def delete(self, fact_id: str) -> None:
        self.facts = self.facts.withColumn("is_active", F.col("is_active") & (F.col("id") != fact_id))

    def erase(self, user_id: str) -> None:
        tables = governance.erase({"facts": self.facts, "chunks": self.chunks}, user_id)
        self.facts, self.chunks = materialise(tables["facts"], "memory-facts"), materialise(tables["chunks"], "memory-chunks")

    def stats(self) -> DataFrame:
        return aggregates.store_stats(self.facts)

    def sparql(self, text: str, user_id: str) -> DataFrame:
        mine = scope_filter(self.facts, user_id).where("is_active")
        return sparql.execute(text, mine.select(F.col("subject").alias("s"), F.col("relation").alias("p"), F.col("value").alias("o")))

    def prompt(self, query: str, user_id: str, k: int = 10, today: date | None = None) -> str:
        return planner.as_prompt(self.search(query, user_id, k=k, today=today))
