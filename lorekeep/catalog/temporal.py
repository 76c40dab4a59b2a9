"""Temporal and aggregate queries over events viewed as facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions.hashing import fact_id
from lorekeep.functions.scoring import fade, retention, step_distance_boost
from lorekeep.operators import aggregates as A
from lorekeep.operators import temporal as T
from lorekeep.sources.tables import event_facts, query_facts, scope_filter, table, turn_chunks

FACTS = """facts AS (
    SELECT event_id AS seq, CAST(event_id AS VARCHAR) AS id, 'u' || user_id AS subject, event_type AS relation,
           CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value, ts AS valid_from, ts AS tx_from, 't' || (user_id % 3) AS user_id,
           CASE WHEN event_id % 4 = 0 THEN 'scout' END AS agent_id, strftime(ts, '%Y-%m-%d') AS run_id,
           0.5 + (event_id % 50) / 100.0 AS confidence, CAST(event_id % 25 AS INTEGER) AS access_count,
           CAST(1 + event_id % 3 AS INTEGER) AS reinforcement, event_id % 11 <> 0 AS is_active, event_id % 97 = 0 AS quarantined
    FROM events)"""
CHAIN = FACTS + """, chain AS (
    SELECT *, lead(valid_from) OVER w AS valid_to, row_number() OVER w AS version, lag(id) OVER w AS predecessor,
           count(*) OVER (PARTITION BY subject, relation) AS chain_length
    FROM facts WINDOW w AS (PARTITION BY subject, relation ORDER BY valid_from, seq))"""
NOW = "2024-03-01"
AT = "2024-01-15"


def facts(spark, d):
    return event_facts(table(spark, d, "events"))


def bitemporal_supersession(spark, d):
    return T.supersession_chain(facts(spark, d)).select("seq", "subject", "relation", "value", "version", "predecessor", "chain_length", "status", F.date_format("valid_to", "yyyy-MM-dd HH:mm:ss").alias("valid_to"))


def flagship(spark, d):
    """Who superseded what: per user and event type the value current at a time, and how often it had changed by then."""
    then = facts(spark, d).where(F.col("valid_from") <= F.lit(AT).cast("timestamp"))
    now = T.as_of(then, AT).select("subject", "relation", "value", "seq")
    return now.join(T.change_counts(then), ["subject", "relation"])


def retention_score(spark, d):
    return facts(spark, d).select("seq", F.round(retention(NOW), 6).alias("score"))


def fade_sweep(spark, d):
    chain = T.supersession_chain(facts(spark, d))
    score = fade(NOW, F.col("chain_length") - F.col("version"))
    return chain.withColumn("score", F.round(score, 6)).where("score < 0.10").select("seq", "score")


def step_boost(spark, d):
    turns = T.step_numbers(turn_chunks(table(spark, d, "conversations")), "session_id", ("position", "id"))
    return turns.select("session_id", "position", "step", F.round(step_distance_boost(F.col("step"), 3, 2), 6).alias("boost"))


def stats_by_scope(spark, d):
    f = facts(spark, d)
    visible = scope_filter(f, "t1", "scout").groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    return visible.withColumn("scope", F.lit("t1/scout"))


def schema_report(spark, d):
    return A.schema_report(facts(spark, d))


def k_anonymous_merge(spark, d):
    per_scope = facts(spark, d).groupBy("user_id", "relation").agg(F.count(F.lit(1)).alias("n"))
    return A.merge_reports(per_scope)


_FADE_SQL = f"""
    WITH {CHAIN}, s AS (
        SELECT seq, chain_length - version AS updates, confidence, access_count, reinforcement,
               greatest((epoch(TIMESTAMP '{NOW}') - floor(epoch(valid_from))) / 86400.0, 0.0) AS age FROM chain),
    r AS (SELECT *, confidence * pow(1 + age / 30.0, -0.5) * (1 + 0.5 * (reinforcement - 1) + 0.1 * least(access_count, 20)) / (1 + 0.25 * updates) AS kept FROM s),
    f AS (SELECT seq, round(kept * exp(-0.05 * age) * (1 + least(0.5 * access_count, 2.5)) * greatest(0.1, 1 - 0.25 * updates), 6) AS score FROM r)
    SELECT seq, score FROM f WHERE score < 0.10"""

QUERIES = {
    "bitemporal_supersession": (
        bitemporal_supersession,
        f"""WITH {CHAIN} SELECT seq, subject, relation, value, version, predecessor, chain_length,
            CASE WHEN valid_to IS NULL THEN 'CURRENT' ELSE 'SUPERSEDED' END AS status, strftime(valid_to, '%Y-%m-%d %H:%M:%S') AS valid_to FROM chain""",
    ),
    "supersession_as_of": (
        flagship,
        f"""WITH {FACTS}, t AS (SELECT * FROM facts WHERE valid_from <= TIMESTAMP '{AT}')
            SELECT subject, relation, arg_max(value, (valid_from, seq)) AS value, arg_max(seq, (valid_from, seq)) AS seq,
                   count(DISTINCT value) AS n_values, count(DISTINCT value) - 1 AS n_changes FROM t GROUP BY subject, relation""",
    ),
    "valid_window_overlap": (
        lambda s, d: T.temporal_window(T.close_intervals(facts(s, d)), "2024-01-10", "2024-01-12").select("seq", "subject", "relation", "value"),
        f"""WITH {CHAIN} SELECT seq, subject, relation, value FROM chain WHERE is_active
            AND (valid_to IS NULL OR valid_to >= TIMESTAMP '2024-01-10') AND valid_from <= TIMESTAMP '2024-01-12'""",
    ),
    "tx_window_point": (
        lambda s, d: T.temporal_window(facts(s, d), "2024-01-10", "2024-01-12", field="tx").select("seq", "value"),
        f"WITH {FACTS} SELECT seq, value FROM facts WHERE is_active AND tx_from >= TIMESTAMP '2024-01-10' AND tx_from < TIMESTAMP '2024-01-13'",
    ),
    "before_after_facade": (
        lambda s, d: T.get_before(T.close_intervals(facts(s, d)), "2024-01-02").select("seq", F.lit("before").alias("side")).unionAll(
            T.get_after(T.close_intervals(facts(s, d)), "2024-01-29").select("seq", F.lit("after").alias("side"))
        ),
        f"""WITH {CHAIN} SELECT seq, 'before' AS side FROM chain WHERE valid_from <= TIMESTAMP '2024-01-02'
            UNION ALL SELECT seq, 'after' FROM chain WHERE valid_to IS NULL OR valid_to >= TIMESTAMP '2024-01-29'""",
    ),
    "as_of_state": (
        lambda s, d: T.as_of(facts(s, d), AT).select("subject", "relation", "value", "seq"),
        f"""WITH {FACTS} SELECT subject, relation, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY subject, relation ORDER BY valid_from DESC, seq DESC) AS r
            FROM facts WHERE valid_from <= TIMESTAMP '{AT}') WHERE r = 1""",
    ),
    "state_at": (
        lambda s, d: T.state_at(facts(s, d), AT).select("seq", "subject", "relation", "value"),
        f"""WITH {FACTS} SELECT seq, subject, relation, value FROM facts WHERE tx_from <= TIMESTAMP '{AT}' AND NOT quarantined
            ORDER BY valid_from DESC, subject, relation, value, id LIMIT 500""",
    ),
    "facts_about": (
        lambda s, d: T.facts_about(facts(s, d), "u7").select("seq", "relation", "value"),
        f"WITH {FACTS} SELECT seq, relation, value FROM facts WHERE subject = 'u7' OR value = 'u7'",
    ),
    "history_of": (
        lambda s, d: T.history_of(facts(s, d), "u7", "click").select("seq", "value"),
        f"WITH {FACTS} SELECT seq, value FROM facts WHERE subject = 'u7' AND relation = 'click'",
    ),
    "history_chain_counts": (
        lambda s, d: T.change_counts(facts(s, d)),
        f"WITH {FACTS} SELECT subject, relation, count(DISTINCT value) AS n_values, count(DISTINCT value) - 1 AS n_changes FROM facts GROUP BY ALL",
    ),
    "fact_scan": (
        lambda s, d: query_facts(facts(s, d), relation="click", user_id="t1", limit=200).select("seq", "subject", "value"),
        f"""WITH {FACTS} SELECT seq, subject, value FROM facts WHERE relation = 'click' AND user_id = 't1' AND is_active AND NOT quarantined
            ORDER BY valid_from, id LIMIT 200""",
    ),
    "scope_visibility": (
        stats_by_scope,
        f"""WITH {FACTS} SELECT relation, count(*) AS n, 't1/scout' AS scope FROM facts
            WHERE user_id = 't1' AND (agent_id IS NULL OR agent_id = 'scout') GROUP BY relation""",
    ),
    "numeric_range": (
        lambda s, d: T.numeric_range(facts(s, d), 10, 40, k=150).select("seq", "number"),
        f"""WITH {FACTS} SELECT seq, coalesce(TRY_CAST(value AS DOUBLE), 0) AS number FROM facts
            WHERE coalesce(TRY_CAST(value AS DOUBLE), 0) BETWEEN 10 AND 40 ORDER BY number, seq LIMIT 150""",
    ),
    "facet_counts": (
        lambda s, d: A.facet_counts(facts(s, d), "relation"),
        f"WITH {FACTS} SELECT relation AS key, count(*) AS n FROM facts WHERE is_active GROUP BY relation",
    ),
    "cube_facets": (
        lambda s, d: A.cube_facets(facts(s, d), "user_id", "relation"),
        f"WITH {FACTS} SELECT user_id, relation, count(*) AS n, grouping_id(user_id, relation) AS level FROM facts GROUP BY CUBE (user_id, relation)",
    ),
    "store_stats": (
        lambda s, d: A.store_stats(facts(s, d)),
        f"""WITH {FACTS} SELECT count(*) AS facts, count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS inactive,
            count(*) FILTER (quarantined) AS quarantined, CAST(0 AS BIGINT) AS derived, count(DISTINCT user_id) AS users, count(DISTINCT subject) AS subjects,
            count(DISTINCT relation) AS relations, CAST(sum(access_count) AS BIGINT) AS accesses FROM facts""",
    ),
    "distinct_users": (lambda s, d: A.users(facts(s, d)), f"WITH {FACTS} SELECT DISTINCT user_id FROM facts"),
    "deterministic_fact_id": (
        lambda s, d: facts(s, d).select("seq", fact_id(("user_id", "agent_id", "run_id", "subject", "relation", "value")).alias("fact_id")),
        f"""WITH {FACTS} SELECT seq, substr(sha256(user_id || chr(31) || coalesce(agent_id, '') || chr(31) || run_id || chr(31) || subject || chr(31) || relation || chr(31) || value), 1, 32) AS fact_id
            FROM facts""",
    ),
    "event_precedence_edges": (
        lambda s, d: T.precedence_edges(facts(s, d)),
        f"""WITH {FACTS} SELECT src, dst, 'TEMPORALLY_PRECEDED_BY' AS kind FROM (SELECT id AS src, lag(id) OVER (PARTITION BY subject ORDER BY valid_from, seq) AS dst FROM facts)
            WHERE dst IS NOT NULL""",
    ),
    "latest_n_preload": (
        lambda s, d: T.latest(facts(s, d), 50).select("seq", "subject", "relation", "value"),
        f"WITH {FACTS} SELECT seq, subject, relation, value FROM facts ORDER BY tx_from DESC, seq DESC LIMIT 50",
    ),
    "diversify_per_relation": (
        lambda s, d: T.diversify(facts(s, d).where("is_active").withColumn("rank", F.col("seq")), 30).select("seq", "relation", "overflow"),
        f"""WITH {FACTS}, r AS (SELECT * FROM facts WHERE is_active),
            o AS (SELECT seq, relation, CAST(row_number() OVER (PARTITION BY relation ORDER BY seq) > 4 AS INTEGER) AS overflow FROM r)
            SELECT seq, relation, overflow FROM o ORDER BY overflow, seq LIMIT 30""",
    ),
    "step_distance_boost": (
        step_boost,
        """WITH t AS (SELECT conv_id AS session_id, turn AS position, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations)
           SELECT session_id, position, step, round(CASE WHEN abs(step - 3) <= 2 THEN 1.6 ELSE 1 + 0.6 * exp(-pow(abs(step - 3) - 2, 2) / 2.0) END, 6) AS boost FROM t""",
    ),
    "retention_score": (
        retention_score,
        f"""WITH {FACTS}, a AS (SELECT *, greatest((epoch(TIMESTAMP '{NOW}') - floor(epoch(valid_from))) / 86400.0, 0.0) AS age FROM facts)
            SELECT seq, round(confidence * pow(1 + age / 30.0, -0.5) * (1 + 0.5 * (reinforcement - 1) + 0.1 * least(access_count, 20)), 6) AS score FROM a""",
    ),
    "fade_sweep": (fade_sweep, _FADE_SQL),
    "schema_report": (
        schema_report,
        f"""WITH {FACTS}, p AS (SELECT relation, subject, count(*) AS n, count(DISTINCT value) AS v, min(valid_from) AS first, max(valid_from) AS last FROM facts GROUP BY ALL)
            SELECT relation, CAST(sum(n) AS BIGINT) AS n, round(avg(CASE WHEN v = 1 THEN 1.0 ELSE 0.0 END), 6) AS single_valued,
                   strftime(min(first), '%Y-%m-%d') AS first_day, strftime(max(last), '%Y-%m-%d') AS last_day FROM p GROUP BY relation""",
    ),
    "k_anonymous_merge": (
        k_anonymous_merge,
        f"""WITH {FACTS} SELECT relation, count(*) AS n, count(DISTINCT user_id) AS n_scopes FROM facts GROUP BY relation HAVING count(DISTINCT user_id) >= 3 AND count(*) >= 3""",
    ),
    "session_summary": (
        lambda s, d: A.session_summaries(facts(s, d)),
        f"""WITH {FACTS}, r AS (SELECT user_id, run_id, relation, count(*) AS n, list_sort(list(DISTINCT value)) AS v FROM facts GROUP BY ALL),
            t AS (SELECT *, sum(n) OVER (PARTITION BY user_id, run_id) AS total FROM r)
            SELECT user_id, run_id, relation, n, array_to_string(v[1:5], ', ') || CASE WHEN len(v) > 5 THEN ' (+' || (len(v) - 5) || ' more)' ELSE '' END AS summary FROM t WHERE total >= 5""",
    ),
    "day_summary": (
        lambda s, d: A.day_summaries(facts(s, d)),
        f"""WITH {FACTS} SELECT user_id, strftime(valid_from, '%Y-%m-%d') AS day, count(*) AS n, array_to_string((list_sort(list(DISTINCT subject)))[1:3], ', ') AS subjects
            FROM facts GROUP BY 1, 2""",
    ),
    "persona_top": (
        lambda s, d: A.persona(facts(s, d)),
        f"""WITH {FACTS}, u AS (SELECT user_id, relation, value, CAST(sum(access_count) AS BIGINT) AS uses FROM facts WHERE access_count >= 3 GROUP BY ALL)
            SELECT user_id, relation, value, uses FROM (SELECT *, row_number() OVER (PARTITION BY user_id, relation ORDER BY uses DESC, value) AS r FROM u) WHERE r = 1""",
    ),
    "memory_tree": (
        lambda s, d: A.memory_tree(facts(s, d)),
        f"""WITH {FACTS} SELECT user_id, count(DISTINCT strftime(valid_from, '%Y-%m-%d')) AS days, count(DISTINCT (strftime(valid_from, '%Y-%m-%d'), run_id)) AS sessions,
            count(*) AS facts FROM facts GROUP BY user_id""",
    ),
    "score_stats": (
        lambda s, d: A.score_stats(retention_score(s, d), "score"),
        f"""WITH {FACTS}, a AS (SELECT *, greatest((epoch(TIMESTAMP '{NOW}') - floor(epoch(valid_from))) / 86400.0, 0.0) AS age FROM facts),
            s AS (SELECT round(confidence * pow(1 + age / 30.0, -0.5) * (1 + 0.5 * (reinforcement - 1) + 0.1 * least(access_count, 20)), 6) AS score FROM a)
            SELECT min(score) AS least, max(score) AS most, round(avg(score), 6) AS mean FROM s""",
    ),
    "daily_tumbling": (
        lambda s, d: T.daily_counts(facts(s, d)),
        f"WITH {FACTS} SELECT strftime(date_trunc('day', valid_from), '%Y-%m-%d') AS day, relation, count(*) AS n FROM facts GROUP BY 1, 2",
    ),
    "session_gap": (
        lambda s, d: T.gap_sessions(facts(s, d)).select("subject", "n", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first")),
        f"""WITH {FACTS}, g AS (SELECT subject, valid_from, CASE WHEN lag(valid_from) OVER w IS NULL OR valid_from >= lag(valid_from) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh
              FROM facts WINDOW w AS (PARTITION BY subject ORDER BY valid_from)),
            i AS (SELECT *, sum(fresh) OVER (PARTITION BY subject ORDER BY valid_from RANGE UNBOUNDED PRECEDING) AS island FROM g)
            SELECT subject, count(*) AS n, strftime(min(valid_from), '%Y-%m-%d %H:%M:%S') AS first FROM i GROUP BY subject, island""",
    ),
    "cooccurrence_prefetch": (
        lambda s, d: T.co_access(facts(s, d)),
        f"""WITH {FACTS}, n AS (SELECT subject, relation, row_number() OVER (PARTITION BY subject ORDER BY valid_from, seq) AS r FROM facts)
            SELECT x.relation AS a, y.relation AS b, count(*) AS weight FROM n x JOIN n y ON x.subject = y.subject AND y.r BETWEEN x.r + 1 AND x.r + 4 GROUP BY 1, 2""",
    ),
    "dedup_audit": (
        lambda s, d: A.dedup_audit(table(s, d, "documents")),
        """WITH t AS (SELECT md5(text) AS h, count(*) AS copies, max(length(text)) AS chars FROM documents GROUP BY 1)
           SELECT CAST(sum(copies) AS BIGINT) AS texts, count(*) AS distinct_texts, CAST(sum(copies * chars) AS BIGINT) AS chars, CAST(sum(chars) AS BIGINT) AS distinct_chars,
                  round(sum(chars) / sum(copies * chars), 6) AS ratio FROM t""",
    ),
    "ability_accuracy": (
        lambda s, d: A.accuracy(table(s, d, "labels").withColumn("hit", (F.col("quality") == 1).cast("double")), "toxic", "hit"),
        """SELECT toxic, count(*) AS n, round(avg(CAST(quality = 1 AS DOUBLE)), 6) AS mean, round(coalesce(stddev(CAST(quality = 1 AS DOUBLE)), 0), 6) AS sd FROM labels GROUP BY toxic""",
    ),
}
