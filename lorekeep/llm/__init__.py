"""Training-data operators: mixing, decontamination, toxicity, sharding, PII, WARC, licences, three kinds of dedup.

Nothing outside this subpackage imports it.  `queries()` / `oracle_sql()` live in `lorekeep.llm.queries`.
"""
