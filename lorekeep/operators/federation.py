"""Replica merging: stamped versions, live winners, digests and deltas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 64


@dataclass
class Clock:
    """Hybrid logical clock; stamps sort as text."""

    node: str
    wall: int = 0
    count: int = 0

    def tick(self, now: int) -> str:
        self.wall, self.count = (now, 0) if now > self.wall else (self.wall, self.count + 1)
        return self.stamp()

    def receive(self, stamp: str, now: int) -> str:
        wall, count = int(stamp[:19]), int(stamp[20:26])
        top = max(now, self.wall, wall)
        if top == self.wall == wall:
            self.count = max(self.count, count) + 1
        elif top == self.wall:
            self.count += 1
        elif top == wall:
            self.count = count + 1
        else:
            self.count = 0
        self.wall = top
        return self.stamp()

    def stamp(self) -> str:
        return f"{self.wall:019d}.{self.count:06d}.{self.node}"


def stamp(micros: Column, count: Column, node: Column) -> Column:
    return F.format_string("%019d.%06d.%s", micros, count, node)


def fact_key(multi_valued: tuple[str, ...] = ()) -> Column:
    """user|subject|relation in lower case, with the value for relations that hold several."""
    value = F.when(F.col("relation").isin(*multi_valued), F.lower("value")) if multi_valued else F.lit(None).cast("string")
    return F.concat_ws("|", F.lower("user_id"), F.lower("subject"), F.lower("relation"), value)


def merge_versions(*replicas: DataFrame) -> DataFrame:
    """Union of versions, one per (key, stamp): the same whatever the order and however often a replica is merged."""
    out = replicas[0]
    for r in replicas[1:]:
        out = out.unionByName(r)
    return out.dropDuplicates(["key", "stamp"])


def winners(versions: DataFrame) -> DataFrame:
    """Per key the version of the highest stamp over every tombstone; keys whose last word is a tombstone have none.

    Two aggregates in one pass per key: no sort, and tasks combine before the shuffle.
    """
    live = F.when(~F.col("tombstone"), F.struct("stamp", "payload"))
    best = versions.groupBy("key").agg(F.max(live).alias("w"), F.max(F.when(F.col("tombstone"), F.col("stamp"))).alias("dead"))
    return best.where("w is not null and (dead is null or w.stamp > dead)").select("key", "w.stamp", "w.payload")


def digest(versions: DataFrame, bucket: Column, fingerprint: Column) -> DataFrame:
    """Per bucket: versions, highest stamp and XOR of fingerprints."""
    return versions.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max("stamp").alias("top"), F.bit_xor(fingerprint).alias("fold"))


def standard_digest(versions: DataFrame) -> DataFrame:
    return digest(versions, F.pmod(F.xxhash64("key"), F.lit(BUCKETS)), F.xxhash64("key", "stamp"))


def delta(ours: DataFrame, their_digest: DataFrame) -> DataFrame:
    """Versions in buckets that differ from a peer's digest: at most 64 buckets decide, so that side is broadcast."""
    mine = standard_digest(ours)
    theirs = their_digest.select(F.col("bucket").alias("tb"), F.col("n").alias("tn"), F.col("fold").alias("tf"))
    differ = mine.join(theirs, F.col("bucket") == F.col("tb"), "left").where("tb is null or n <> tn or fold <> tf").select("bucket")
    return ours.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS))).join(F.broadcast(differ), "bucket", "left_semi").drop("bucket")


def collect_tombstones(versions: DataFrame, older_than: str) -> DataFrame:
    """Payloads of tombstones before a stamp are cleared; the tombstones stay."""
    old = F.col("tombstone") & (F.col("stamp") < older_than)
    return versions.withColumn("payload", F.when(old, F.lit(None).cast("string")).otherwise(F.col("payload")))


def canonical(versions: DataFrame) -> list[str]:
    """Sorted text of all versions, the test for convergence; for small states."""
    rows = versions.select(F.to_json(F.struct("key", "stamp", "payload", "tombstone")).alias("j")).orderBy("j")
    return [r["j"] for r in rows.toLocalIterator()]


def to_versions(facts: DataFrame, node: str, multi_valued: tuple[str, ...] = ()) -> DataFrame:
    """Facts as versions (key, stamp, payload, tombstone, purge): closed or inactive facts are tombstones."""
    payload = F.to_json(F.struct("user_id", "subject", "relation", "value", F.unix_micros("valid_from").alias("valid_from")))
    return facts.select(
        fact_key(multi_valued).alias("key"), stamp(F.unix_micros("tx_from"), F.col("seq") % 1_000_000, F.lit(node)).alias("stamp"), payload.alias("payload"), (~F.col("is_active")).alias("tombstone"), F.lit(False).alias("purge")
    )


def to_facts(versions: DataFrame) -> DataFrame:
    """The winning versions as facts."""
    shape = "user_id string, subject string, relation string, value string, valid_from bigint"
    return winners(versions).select("stamp", F.from_json("payload", shape).alias("f")).select("f.user_id", "f.subject", "f.relation", "f.value", F.timestamp_micros("f.valid_from").alias("valid_from"), "stamp")


def synchronise(ours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both replicas after a two-way exchange of what differs: each sends the buckets that the other's digest lacks or has otherwise."""
    sent, received = delta(ours, standard_digest(theirs)), delta(theirs, standard_digest(ours))
    return merge_versions(ours, received), merge_versions(theirs, sent)
