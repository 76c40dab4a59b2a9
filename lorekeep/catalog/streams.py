"""Streaming queries, run to the end over the events table and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.catalog.temporal import FACTS
from lorekeep.sources.tables import event_facts
from lorekeep.streaming import ingest as S

SINGLE = ("click", "view")


def fact_stream(s, d):
    return event_facts(S.parquet_stream(s, f"{d}/events.parquet"))


def decisions(s, d):
    return S.run_available(S.truth_maintenance(fact_stream(s, d), SINGLE), "stream-truth").select("seq", "decision")


def daily(s, d):
    return S.run_with_merge(S.daily_counts(fact_stream(s, d)), "stream-daily", ["day", "relation"])


def versions(s, d):
    v = fact_stream(s, d).select(F.concat_ws("|", "subject", "relation").alias("key"), F.col("seq").cast("string").alias("stamp"), F.col("valid_from").alias("ts"))
    twice = v.unionAll(v)
    return S.run_available(S.unique_versions(twice, "60 days"), "stream-versions").select("key", "stamp")


QUERIES = {
    "stream_truth_maintenance": (
        decisions,
        f"""WITH {FACTS}, b AS (SELECT seq, relation, value, lag(value) OVER (PARTITION BY subject, relation ORDER BY valid_from, seq) AS before FROM facts)
            SELECT seq, CASE WHEN before IS NULL THEN 'COMMIT' WHEN before = value THEN 'SKIP' WHEN relation IN ('click', 'view') THEN 'SUPERSEDE' ELSE 'COEXIST' END AS decision FROM b""",
    ),
    "stream_daily_counts": (daily, f"WITH {FACTS} SELECT strftime(valid_from, '%Y-%m-%d') AS day, relation, count(*) AS n FROM facts GROUP BY 1, 2"),
    "stream_unique_versions": (versions, f"WITH {FACTS} SELECT subject || '|' || relation AS key, CAST(seq AS VARCHAR) AS stamp FROM facts"),
}
