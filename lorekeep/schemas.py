"""Table schemas of the fact store, as DDL."""

from __future__ import annotations

FACTS = """id STRING, subject STRING, relation STRING, value STRING, valid_from TIMESTAMP, valid_to TIMESTAMP,
tx_from TIMESTAMP, tx_to TIMESTAMP, confidence DOUBLE, source_hash STRING, source_id STRING, user_id STRING,
agent_id STRING, run_id STRING, memory_type STRING, kind STRING, access_count INT, reinforcement INT, is_active BOOLEAN,
is_derived BOOLEAN, quarantined BOOLEAN, birth_commit STRING, retired_commit STRING, provenance MAP<STRING, STRING>"""
EDGES = "src STRING, dst STRING, kind STRING, meta STRING, created TIMESTAMP"
CHUNKS = """id STRING, text STRING, user_id STRING, agent_id STRING, run_id STRING, ts TIMESTAMP, source STRING,
hash STRING, tokens INT"""
NEGATIONS = """id STRING, user_id STRING, agent_id STRING, session_id STRING, sentence STRING, marker STRING,
implied_subject STRING, source_tx_id STRING, source_hash STRING, created_at TIMESTAMP, is_active BOOLEAN"""
COMMITS = "id STRING, parents ARRAY<STRING>, branch STRING, message STRING, ts TIMESTAMP, chain_hash STRING, n_facts INT"
BRANCHES = "name STRING, head STRING, created TIMESTAMP"
VECTORS = "fact_id STRING, record BINARY, vec_hash STRING, ts TIMESTAMP"
AUDIT = """seq BIGINT, ts TIMESTAMP, actor STRING, role STRING, action STRING, resource STRING, outcome STRING,
meta STRING, prev_hash STRING, hash STRING"""
CRDT = "key STRING, stamp STRING, payload STRING, tombstone BOOLEAN, purge BOOLEAN"

DEFAULTS = {
    "confidence": 0.8,
    "user_id": "default",
    "memory_type": "short_term",
    "kind": "fact",
    "reinforcement": 1,
    "access_count": 0,
    "is_active": True,
    "is_derived": False,
    "quarantined": False,
}
