"""Structured Streaming: windowed counts, version dedup, and stateful truth maintenance."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorekeep.scratch import scratch_path

DECIDED = "subject string, relation string, seq bigint, value string, decision string, at bigint, ends bigint"
#: The time, in microseconds, of what has none; after all others.
NEVER = 1 << 62


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over a Parquet table, its schema taken from the table."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a glob, since a stream over one plain file is refused


def run_available(df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process everything available, exactly once, into a Parquet table; offsets and state live in the shared folder."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    query = df.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


def run_with_merge(df: DataFrame, label: str, key: list[str]) -> DataFrame:
    """Update-mode aggregates kept as one table per batch; the last batch's row per key wins on read."""
    spark = df.sparkSession
    path = scratch_path(spark, label)

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/b={number}")

    query = df.writeStream.outputMode("update").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{path}/rows").drop("b")
    rest = [c for c in rows.columns if c not in (*key, "__batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "__batch").alias("x")).select(*key, "x.*")


def daily_counts(facts: DataFrame, late: str = "2 days") -> DataFrame:
    """Facts per day and relation; a day closes once the watermark has passed it."""
    return (
        facts.withWatermark("valid_from", late)
        .groupBy(F.window("valid_from", "1 day").alias("w"), "relation")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "relation", "n")
    )


def hourly_sessions(facts: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    return (
        facts.withWatermark("valid_from", late)
        .groupBy("subject", F.session_window("valid_from", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("subject", F.col("w.start").alias("first"), "n")
    )


def unique_versions(versions: DataFrame, late: str = "7 days") -> DataFrame:
    """Each (key, stamp) once, however often and in whatever order it is delivered within the watermark."""
    return versions.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key", "stamp"])


def _similar(a: str, b: str) -> float:
    if a.strip().lower() == b.strip().lower():
        return 1.0
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x | y else 0.0


def _decide(single: bool, merge_at: float, known: list, starts: list, at, value: str) -> tuple:
    """The decision on one statement and, of one filed before others, its end.  `known` are the intervals [start, end, value,
    reinforcement] in order of start, `starts` their starts."""
    place = bisect_right(starts, at)
    last = known[place - 1] if place else None
    if not known:
        known.append([at, None, value, 1])
        starts.append(at)
        return "COMMIT", None
    if last is None and known[0][2].strip().lower() == value.strip().lower():
        known[0][0] = starts[0] = at  # an older restatement of the first value
        return "SKIP", None
    if last is not None and last[2].strip().lower() == value.strip().lower():
        last[3] += 1
        return "SKIP", None
    if last is not None and _similar(last[2], value) >= merge_at:
        last[3] += 1
        return "MERGE", None
    ends, decision = None, "COEXIST"
    if single:
        decision, ends = "SUPERSEDE", starts[place] if place < len(known) else None
        if last is not None:
            last[1] = at
    known.insert(place, [at, ends, value, 1])
    starts.insert(place, at)
    return decision, ends


def _maintain(single_valued: frozenset[str], merge_at: float):
    """State per key (subject, relation): the value intervals in order of valid_from.  Nothing is dropped as late; an older statement
    of the current value moves its interval's start back, any other late value is filed where its time belongs."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        subject, relation = key
        known = json.loads(state.get[0]) if state.exists else []
        starts, rows = [k[0] for k in known], []
        for r in pd.concat(list(batches)).sort_values(["valid_from", "seq"]).itertuples(index=False):
            decision, ends = _decide(relation in single_valued, merge_at, known, starts, r.valid_from.isoformat(), r.value)
            rows.append((subject, relation, r.seq, r.value, decision, r.valid_from, pd.Timestamp(ends) if ends else pd.NaT))
        state.update((json.dumps(known),))
        yield pd.DataFrame(rows, columns=["subject", "relation", "seq", "value", "decision", "valid_from", "valid_to"])

    return step


def _maintain_subject(single_valued: frozenset[str], merge_at: float):
    """As `_maintain`, for a subject's relations at once, with times in microseconds: tables of a few rows cost more than what is
    decided on them, so a subject gets one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(json.loads(state.get[0])) if state.exists else {}  # relation, null too: intervals of [start, end, value, reinforcement]
        starts = {relation: [k[0] for k in known] for relation, known in held.items()}
        rows = sorted((row for b in batches for row in zip(*(b[c].tolist() for c in ("at", "seq", "relation", "value")))), key=lambda r: r[:2])
        made = [_decide(r[2] in single_valued, merge_at, held.setdefault(r[2], []), starts.setdefault(r[2], []), r[0], r[3]) for r in rows]
        state.update((json.dumps(list(held.items())),))
        at, seq, relation, value = zip(*rows)
        decision, ends = zip(*made)
        columns = {"subject": key[0], "relation": relation, "seq": seq, "value": value, "decision": decision, "at": at, "ends": [NEVER if e is None else e for e in ends]}
        yield pd.DataFrame(columns)

    return step


def truth_maintenance(facts: DataFrame, single_valued: tuple[str, ...], merge_at: float = 0.92) -> DataFrame:
    """Per fact of a stream, what it does to what is known of its (subject, relation)."""
    time = lambda c: F.timestamp_micros(F.when(F.col(c) != NEVER, F.col(c)))
    return (
        facts.select("subject", "relation", "seq", "value", F.coalesce(F.unix_micros("valid_from"), F.lit(NEVER)).alias("at"))
        .groupBy("subject")
        .applyInPandasWithState(_maintain_subject(frozenset(single_valued), merge_at), DECIDED, "known string", "append", GroupStateTimeout.NoTimeout)
        .select("subject", "relation", "seq", "value", "decision", time("at").alias("valid_from"), time("ends").alias("valid_to"))
    )


def compact_under_pressure(path: str, threshold: int, compact):
    """A foreachBatch sink that keeps every batch under `path`, and rewrites the table by `compact(rows)` once more than
    `threshold` rows came since the last time.

    A batch that is delivered again replaces itself.  What is pending is counted in the table, so a restart forgets nothing;
    a compaction is written beside the old version and then marked, so one that broke off leaves the old version valid.
    Read the table with `compacted`.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version, last = _version(spark, path)
        if number <= last:
            return  # this batch is part of the compacted version already
        batch.write.mode("overwrite").parquet(f"{path}/rows/b={number}")
        pending = spark.read.schema(batch.schema).parquet(f"{path}/rows").where(F.col("b") > last)
        if pending.count() > threshold:
            compact(compacted(spark, path, batch.schema)).write.mode("overwrite").parquet(f"{path}/v{version + 1}")
            spark.createDataFrame([(version + 1, number)], "version int, last bigint").coalesce(1).write.mode("append").parquet(f"{path}/marks")

    return sink


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _version(spark: SparkSession, path: str) -> tuple[int, int]:
    """The last compacted version and the last batch in it."""
    if not _exists(spark, f"{path}/marks"):
        return 0, -1
    mark = spark.read.schema("version int, last bigint").parquet(f"{path}/marks").orderBy(F.desc("version")).first()
    return (mark["version"], mark["last"]) if mark else (0, -1)


def compacted(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table that `compact_under_pressure` keeps: the last compacted version and the batches since."""
    version, last = _version(spark, path)
    columns = schema.fieldNames()
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    rows = rows.where(F.col("b") > last).select(*columns)
    return rows if not version else spark.read.schema(schema).parquet(f"{path}/v{version}").select(*columns).unionByName(rows)
