"""Queries over joins, closures, judgements and helpers that the other groups leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.catalog.graph import _CO, COMMITTED, SPARSE, TRIPLES, VERSIONS, commits, committed, replicas, sparse, triple_facts
from lorekeep.catalog.temporal import CHAIN, FACTS, facts
from lorekeep.catalog.text import docs, turns
from lorekeep.catalog.vectors import E, query, rows
from lorekeep.functions import arrays as A
from lorekeep.functions import text as X
from lorekeep.operators import aggregates as G
from lorekeep.operators import cognition as P
from lorekeep.operators import extraction as B
from lorekeep.operators import federation as R
from lorekeep.operators import fulltext as T
from lorekeep.operators import graph as K
from lorekeep.operators import lifecycle as L
from lorekeep.operators import recall as Q
from lorekeep.operators import temporal as M
from lorekeep.operators import vectors as V
from lorekeep.operators import versioning as C
from lorekeep.plans import sparql
from lorekeep.sources import importers as I
from lorekeep.sources import tables as S
from lorekeep.sources.tables import dimension_triples, event_edges, table

_CONTENT = ", ".join(f"'{x}'" for x in X.STOPWORDS["en"])


def _words_sql(text):
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z][a-z''’-]*|\\d+(?:\\.\\d+)?'), lambda x: length(x) > 1 AND x NOT IN ({_CONTENT})))"


def _contradictions(s, d):
    """Consecutive events of one user with different types contradict each other on even days."""
    e = table(s, d, "events").select("event_id", "event_type", "ts")
    edges = event_edges(table(s, d, "events"))
    a, b = e.select(F.col("event_id").alias("src"), F.col("event_type").alias("ta"), F.dayofmonth("ts").alias("day")), e.select(F.col("event_id").alias("dst"), F.col("event_type").alias("tb"))
    return edges.join(a, "src").join(b, "dst").where("ta = tb AND day % 2 = 0").select("src", "dst", F.lit("CONTRADICTS").alias("kind"))


def _closure(s, d):
    start = table(s, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("start"))
    return K.history_closure(_contradictions(s, d), start).where("start <> id")


_CLOSURE = """WITH RECURSIVE o AS (SELECT event_id, event_type, ts, lag(event_id) OVER w AS dst, lag(event_type) OVER w AS tb FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    c AS (SELECT event_id AS src, dst FROM o WHERE dst IS NOT NULL AND event_type = tb AND day(ts) % 2 = 0), b AS (SELECT src, dst FROM c UNION ALL SELECT dst, src FROM c),
    r AS (SELECT event_id AS start, event_id AS id FROM events WHERE event_type = 'purchase' UNION SELECT r.start, b.dst FROM r JOIN b ON b.src = r.id)
    SELECT start, id FROM r WHERE start <> id"""


def _aliases(s, d):
    nation = table(s, d, "nation")
    aliases = nation.select(F.concat(F.lit("N"), "n_nationkey").alias("alias"), F.col("n_name").alias("name"))
    mentions = table(s, d, "customer").select(
        F.col("c_custkey").alias("query"), F.explode(F.array(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("N"), F.col("c_custkey") % 25), F.col("c_mktsegment"), F.lit("Somebody Else"), F.lit("It"))).alias("mention")
    )
    return Q.canonical_entities(mentions, aliases)


def _judged(s, d):
    t = turns(s, d)
    score = Q.judge(F.col("text"), F.array(F.lit("thing"), F.lit("WITH")), F.array(F.lit("the")), F.array(F.lit("zzz"), F.lit("ering")))
    return t.groupBy(score.alias("score")).agg(F.count(F.lit(1)).alias("n"))


def _assessed(s, d):
    a = L.assess(facts(s, d), ("click", "view"))
    return a.select("seq", "decision", "interference", "audit")


def _gate(s, d):
    v = rows(s, d)
    return L.overlap_gate(v.where("id % 20 = 0"), v.where("id % 20 <> 0"), 0.4).select("id", F.round("nearest", 4).alias("nearest"), "added")


def _synced(s, d):
    ours, theirs = replicas(s, d)
    a, b = R.synchronise(ours, theirs)
    return a.select("key", "stamp", F.lit("a").alias("side")).unionByName(b.select("key", "stamp", F.lit("b").alias("side")))


def _sourced(s, d):
    """Customers of the region r1, with the document that the fact about their nation comes from."""
    t = dimension_triples(s, d).withColumn("source_id", F.when(F.col("p") == "lives_in", F.expr("CAST(try_cast(substring(s, 2) AS BIGINT) % 500 AS STRING)")))
    found = sparql.execute("SELECT ?c ?n WHERE { ?c lives_in ?n . ?n member_of r1 }", t.select("s", "p", "o"))
    chunks = docs(s, d).select("id", F.substring("text", 1, 20).alias("text"))
    return sparql.with_sources(found, ("?c", "lives_in", "?n"), t, chunks)


def _mentions(s, d):
    return B.mention_fallback(docs(s, d).where("lang = 'en'"), s.range(1).select(F.lit("the").alias("subject"))).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


def _unextracted(s, d):
    known = s.range(1).select(F.lit(None).cast("bigint").alias("source_id")).unionByName(table(s, d, "labels").select(F.col("doc_id").alias("source_id")))
    return B.unextracted(docs(s, d).select("id", "lang"), known)


def _prefixes(s, d):
    asked = table(s, d, "benchmark").select(F.explode(F.array(F.substring(F.lower("text"), 1, 2), F.substring(F.lower("text"), 1, 3))).alias("prefix")).where(F.length(F.trim("prefix")) >= 2)
    return T.expand_prefixes(asked, T.vocabulary(docs(s, d), 2), 3)


def _idiolects(s, d):
    said = turns(s, d).select("id", F.col("agent_id").alias("user_id"), "text")
    pairs = said.select("user_id").distinct().select("user_id", F.lit("The").alias("said"), F.concat(F.lit("<"), "user_id", F.lit(">")).alias("meant")).where("user_id = 'user'")
    return T.normalise_idiolect(said, pairs, {"the": "THE", "of": "OF"}).select("id", F.md5("text").alias("hash"))


def _chats(s, d):
    """Conversations nested as benchmark rows are, a session per conversation and a batch per two turns, and flattened again."""
    c = table(s, d, "conversations")
    batches = c.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("batch_number")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("turns")
    )
    nested = batches.groupBy(F.col("conv_id").alias("conversation_id")).agg(F.array(F.array_sort(F.collect_list(F.struct("batch_number", "turns")))).alias("chat"))
    return I.flatten_chats(nested).groupBy("conversation_id", "batch_number", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"), F.max("position").alias("last"))


def _sets_judged(s, d):
    sets = facts(s, d).groupBy("subject").agg(F.collect_set(F.when(F.col("seq") % 2 == 0, F.col("value"))).alias("expected"), F.collect_set(F.when(F.col("seq") % 3 == 0, F.col("value"))).alias("found"))
    return Q.judge_sets(sets).select("subject", "f1", "met")


QUERIES = {
    "prefix_expansion": (
        _prefixes,
        """WITH q AS (SELECT DISTINCT unnest([substr(lower(text), 1, 2), substr(lower(text), 1, 3)]) AS prefix FROM benchmark), v AS (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS term FROM documents) GROUP BY term HAVING count(*) >= 2)
           SELECT prefix, term, n FROM q JOIN v ON starts_with(term, prefix) WHERE length(trim(prefix)) >= 2 QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY n DESC, term) <= 3""",
    ),
    "idiolect_texts": (
        _idiolects,
        """SELECT conv_id * 1000 + turn AS id, md5(array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN lower(w) = 'the' AND role = 'user' THEN '<user>' WHEN lower(w) = 'the' THEN 'THE' WHEN lower(w) = 'of' THEN 'OF' ELSE w END), ' ')) AS hash FROM conversations""",
    ),
    "nested_chats": (
        _chats,
        """WITH t AS (SELECT conv_id, turn // 2 AS batch_number, role, text, row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn) - 1 AS position FROM conversations)
           SELECT conv_id AS conversation_id, batch_number, role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(position) AS INTEGER) AS last FROM t GROUP BY ALL""",
    ),
    "set_judge": (
        _sets_judged,
        f"""WITH {FACTS}, s AS (SELECT subject, coalesce(list(DISTINCT value) FILTER (seq % 2 = 0), []) AS e, coalesce(list(DISTINCT value) FILTER (seq % 3 = 0), []) AS f FROM facts GROUP BY subject),
            x AS (SELECT subject, CASE WHEN len(e) = 0 THEN 1.0::DOUBLE WHEN len(list_intersect(e, f)) = 0 THEN 0.0::DOUBLE ELSE 2 * len(list_intersect(e, f)) / (len(e) + len(f)) END AS f1 FROM s) SELECT subject, round(f1, 6) AS f1, f1 >= 0.5 AS met FROM x""",
    ),
    "session_brief": (
        lambda s, d: G.session_brief(facts(s, d)).select("user_id", "run_id", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "n", "brief"),
        f"""WITH {FACTS}, r AS (SELECT user_id, run_id, relation, arg_max(value, (tx_from, seq)) AS v, count(*) AS n, min(tx_from) AS a, max(tx_from) AS b FROM facts GROUP BY ALL)
            SELECT user_id, run_id, strftime(min(a), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(b), '%Y-%m-%d %H:%M:%S') AS last, CAST(sum(n) AS BIGINT) AS n, string_agg(relation || '=' || v, '; ' ORDER BY relation) AS brief FROM r GROUP BY user_id, run_id""",
    ),
    "cognition_pass": (
        lambda s, d: P.cognition_pass(sparse(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
        f"""WITH {SPARSE}, {_CO}, t AS (SELECT subject, array_to_string(list_sort(list(DISTINCT relation)), ',') AS relations FROM facts GROUP BY subject),
            g AS (SELECT DISTINCT subject, b AS relation FROM has JOIN co ON co.a = has.relation AND fraction >= 0.5 WHERE (subject, b) NOT IN (SELECT (subject, relation) FROM has)),
            n AS (SELECT 'prototype' AS kind, (SELECT count(*) FROM (SELECT relations FROM t GROUP BY relations HAVING count(*) >= 2)) AS n UNION ALL SELECT 'gap', (SELECT count(*) FROM g) UNION ALL SELECT 'hypothesis', (SELECT count(*) FROM g)
              UNION ALL SELECT 'analogy', (SELECT count(*) FROM co JOIN sizes x ON x.relation = a JOIN sizes y ON y.relation = b WHERE a < b AND shared >= 2 AND shared / (x.n + y.n - shared) >= 0.4))
            SELECT kind, n FROM n WHERE n > 0""",
    ),
    "valid_while": (
        lambda s, d: M.valid_while(M.close_intervals(facts(s, d)), "purchase", "10").select("seq"),
        f"""WITH {CHAIN} SELECT f.seq FROM chain f WHERE f.relation <> 'purchase' AND EXISTS (SELECT 1 FROM chain a WHERE a.relation = 'purchase' AND a.value = '10' AND a.user_id = f.user_id AND a.subject = f.subject
            AND (a.valid_to IS NULL OR f.valid_from < a.valid_to) AND (f.valid_to IS NULL OR f.valid_to > a.valid_from))""",
    ),
    "trajectory": (
        lambda s, d: M.trajectory(facts(s, d)).select("seq", "step", "previous"),
        f"""WITH {FACTS} SELECT seq, CAST(row_number() OVER (PARTITION BY user_id, run_id ORDER BY tx_from, seq) AS INTEGER) AS step,
            lag(value) OVER (PARTITION BY user_id, run_id, subject, relation ORDER BY tx_from, seq) AS previous FROM facts""",
    ),
    "best_event_by_overlap": (
        lambda s, d: M.best_by_overlap(
            table(s, d, "benchmark").select(F.col("item_id").alias("key"), X.content_words(F.col("text")).alias("words")), turns(s, d).select("id", X.content_words(F.col("text")).alias("words"))
        ),
        f"""WITH a AS (SELECT item_id AS key, unnest({_words_sql('text')}) AS w FROM benchmark), b AS (SELECT conv_id * 1000 + turn AS id, unnest({_words_sql('text')}) AS w FROM conversations),
            c AS (SELECT key, id, count(*) AS shared FROM a JOIN b USING (w) GROUP BY ALL)
            SELECT key, id, shared FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY shared DESC, id) = 1""",
    ),
    "lifecycle_assess": (
        _assessed,
        f"""WITH {FACTS}, o AS (SELECT *, row_number() OVER (PARTITION BY subject, relation ORDER BY valid_from, seq) AS r, lag(value) OVER (PARTITION BY subject, relation ORDER BY valid_from, seq) AS before FROM facts),
            e AS (SELECT o.seq, CAST(max(CAST(p.value = o.value AS INTEGER)) AS DOUBLE) AS near FROM o JOIN o p ON o.subject = p.subject AND o.relation = p.relation AND p.r BETWEEN o.r - 8 AND o.r - 1 GROUP BY o.seq),
            x AS (SELECT o.*, CASE WHEN before IS NULL THEN 'COMMIT' WHEN before = value THEN 'SKIP' WHEN relation IN ('click', 'view') THEN 'SUPERSEDE' ELSE 'COEXIST' END AS decision FROM o),
            y AS (SELECT x.*, CASE decision WHEN 'COEXIST' THEN near ELSE 0.0::DOUBLE END AS interference FROM x LEFT JOIN e USING (seq))  -- different numbers have no word in common
            SELECT seq, decision, interference, decision = 'SUPERSEDE' AND interference > 0.75 AND confidence < 0.6 AS audit FROM y""",
    ),
    "overlap_gate": (
        _gate,
        f"""WITH {E}, s AS (SELECT a.id, max(round(list_cosine_similarity(a.v, b.v), 6)) AS c FROM e a JOIN e b ON a.id % 20 = 0 AND b.id % 20 <> 0 GROUP BY a.id) SELECT id, round(c, 4) AS nearest, c <= 0.4 AS added FROM s""",
    ),
    "access_bump": (
        lambda s, d: L.bump_access(facts(s, d), table(s, d, "lineitem").select((F.col("l_orderkey") % 100).cast("string").alias("id"))).select("seq", "access_count"),
        f"WITH {FACTS}, n AS (SELECT CAST(l_orderkey % 100 AS VARCHAR) AS id, count(*) AS n FROM lineitem GROUP BY 1) SELECT seq, CAST(access_count + coalesce(n, 0) AS INTEGER) AS access_count FROM facts LEFT JOIN n USING (id)",
    ),
    "provenance_predicate": (
        lambda s, d: L.provenance_has(facts(s, d), "k", "7").select("seq"),
        "SELECT event_id AS seq FROM events WHERE json_extract_string(props, '$.k') = '7'",
    ),
    "history_closure": (_closure, _CLOSURE),
    "negation_overlap": (
        lambda s, d: T.negation_overlap(table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text"), turns(s, d).select("id", "text"), 3),
        f"""WITH a AS (SELECT item_id AS query, unnest({_words_sql('text')}) AS w FROM benchmark), b AS (SELECT conv_id * 1000 + turn AS negation, unnest({_words_sql('text')}) AS w FROM conversations)
            SELECT query, negation, count(*) AS shared FROM a JOIN b USING (w) GROUP BY ALL HAVING count(*) >= 3""",
    ),
    "dense_only": (
        lambda s, d: T.dense_only(rows(s, d), query(s, d), 10),
        f"WITH {E} SELECT id, round(0.6 * list_cosine_similarity(v, q), 6) AS score FROM e, q ORDER BY score DESC, id LIMIT 10",
    ),
    "alias_join": (
        _aliases,
        """WITH m AS (SELECT c_custkey AS query, unnest(['n' || c_nationkey, 'N' || (c_custkey % 25), c_mktsegment, 'Somebody Else', 'It']) AS mention FROM customer),
           a AS (SELECT lower('N' || n_nationkey) AS alias, n_name AS name FROM nation), f AS (SELECT DISTINCT query, coalesce(name, mention) AS entity FROM m LEFT JOIN a ON lower(mention) = alias)
           SELECT query, entity, CAST(row_number() OVER (PARTITION BY query ORDER BY length(entity) DESC, entity) AS INTEGER) AS place FROM f QUALIFY place <= 4""",
    ),
    "nugget_judge": (
        _judged,
        """SELECT CASE WHEN contains(lower(text), 'zzz') OR contains(lower(text), 'ering') THEN 0.0 WHEN NOT (contains(lower(text), 'thing') OR contains(lower(text), 'with')) THEN 0.0
               WHEN NOT contains(lower(text), 'the') THEN 0.5 ELSE 1.0 END::DOUBLE AS score, count(*) AS n FROM conversations GROUP BY 1""",
    ),
    "integer_sum": (
        lambda s, d: G.integer_sum(facts(s, d)),
        f"WITH {FACTS} SELECT relation, count(try_cast(value AS BIGINT)) AS n, CAST(sum(try_cast(value AS BIGINT)) AS BIGINT) AS total FROM facts GROUP BY relation",
    ),
    "branch_heads": (
        lambda s, d: C.create_branch(C.branch_heads(commits(s, d)), "trial", "main-10"),
        """WITH c AS (SELECT DISTINCT day(ts) AS n FROM events) SELECT 'main' AS branch, printf('main-%02d', max(n)) AS head, count(*) AS n FROM c
           UNION ALL SELECT 'side', printf('side-%02d', max(n)), count(*) FROM c WHERE n BETWEEN 11 AND 15 UNION ALL SELECT 'trial', 'main-10', 0""",
    ),
    "branch_checkout": (
        lambda s, d: C.checkout(committed(s, d), commits(s, d), C.branch_heads(commits(s, d)), "side").select("seq", "value"),
        f"WITH {COMMITTED} SELECT seq, value FROM on_side",
    ),
    "anti_entropy": (
        _synced,
        f"WITH {VERSIONS}, v AS (SELECT DISTINCT key, stamp FROM versions) SELECT key, stamp, 'a' AS side FROM v UNION ALL SELECT key, stamp, 'b' FROM v",
    ),
    "crdt_bridge": (
        lambda s, d: R.to_facts(R.to_versions(facts(s, d), "n1")).select("user_id", "subject", "relation", "value"),
        f"""WITH {FACTS}, v AS (SELECT *, printf('%019d.%06d.n1', epoch_us(tx_from), seq % 1000000) AS stamp FROM facts),
            w AS (SELECT subject, relation, user_id, max(stamp) FILTER (is_active) AS live, max(stamp) FILTER (NOT is_active) AS dead, arg_max(value, stamp) FILTER (is_active) AS value FROM v GROUP BY ALL)
            SELECT user_id, subject, relation, value FROM w WHERE live IS NOT NULL AND (dead IS NULL OR live > dead)""",
    ),
    "vector_storage_stats": (
        lambda s, d: V.storage_stats(rows(s, d)),
        """SELECT count(*) AS n, CAST(max(len(embedding)) AS INTEGER) AS dims, CAST(sum(len(embedding) * 4) AS BIGINT) AS float_bytes, CAST(sum(len(embedding) + 4) AS BIGINT) AS int8_bytes,
           CAST(sum(ceil(len(embedding) / 8.0)) AS BIGINT) AS binary_bytes FROM embeddings""",
    ),
    "missing_vectors": (
        lambda s, d: V.missing_vectors(table(s, d, "events").select(F.col("event_id").alias("id")), rows(s, d).select(F.col("id").alias("fact_id"))),
        "SELECT event_id AS id FROM events WHERE event_id NOT IN (SELECT vec_id FROM embeddings)",
    ),
    "sparql_sources": (
        _sourced,
        f"""WITH {TRIPLES} SELECT a.s AS c, a.o AS n, CAST(CAST(substr(a.s, 2) AS BIGINT) % 500 AS VARCHAR) AS _source, coalesce(substr(text, 1, 20), '') AS source_text
            FROM triples a JOIN triples b ON a.o = b.s AND b.p = 'member_of' AND b.o = 'r1' LEFT JOIN documents ON doc_id = CAST(substr(a.s, 2) AS BIGINT) % 500 WHERE a.p = 'lives_in'""",
    ),
    "mention_fallback": (
        _mentions,
        r"""WITH m AS (SELECT doc_id AS source_id, unnest(list_distinct(regexp_extract_all(text, '\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*'))) AS v FROM documents WHERE lang = 'en')
            SELECT source_id, count(*) AS n FROM m WHERE contains(v, ' ') OR lower(v) = 'the' GROUP BY source_id""",
    ),
    "unextracted_chunks": (_unextracted, "SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "char_ngram_jaccard": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.round(X.ngram_jaccard(F.col("p_name"), F.col("p_type")), 6).alias("score")),
        """WITH g AS (SELECT p_partkey, CASE WHEN length(p_name) < 3 THEN [p_name] ELSE list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3))) END AS a,
               CASE WHEN length(p_type) < 3 THEN [p_type] ELSE list_distinct(list_transform(range(1, length(p_type) - 1), lambda i: substr(p_type, i, 3))) END AS b FROM part)
           SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS score FROM g""",
    ),
    "value_similarity": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.round(X.edit_similarity(F.col("p_name"), F.col("p_brand")), 6).alias("score")),
        "SELECT p_partkey, round(1 - levenshtein(p_name, p_brand) / greatest(length(p_name), length(p_brand), 1)::DOUBLE, 6) AS score FROM part",
    ),
    "capital_runs": (
        lambda s, d: turns(s, d).select("id", F.size(X.cap_sequences(F.col("text"))).alias("n"), F.element_at(X.cap_sequences(F.col("text")), 1).alias("first")).where("n > 0"),
        r"""WITH c AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(text, '\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*') AS c FROM conversations) SELECT id, CAST(len(c) AS INTEGER) AS n, c[1] AS first FROM c WHERE len(c) > 0""",
    ),
    "currency_amounts": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", F.element_at(X.currency_amounts(F.concat(F.lit("paid €"), F.format_string("%.2f", "o_totalprice"), F.lit(" on time"))), 1).alias("x")).select("o_orderkey", "x.currency", "x.amount"),
        "SELECT o_orderkey, 'EUR' AS currency, CAST(printf('%.2f', o_totalprice) AS DOUBLE) AS amount FROM orders",
    ),
    "fact_kinds": (
        lambda s, d: turns(s, d).groupBy(X.classify_kind(F.concat(F.when(F.col("position") % 2 == 0, "we visited ").otherwise("it stands "), F.col("text"))).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
        r"""WITH t AS (SELECT lower(CASE WHEN turn % 2 = 0 THEN 'we visited ' ELSE 'it stands ' END || text) AS t FROM conversations)
           SELECT CASE WHEN regexp_matches(t, '\b(i|we|my|our)\b') AND regexp_matches(t, '\b(went|saw|met|had|did|made|took|felt|visited|bought|learned|started|finished|[a-z]{3,}ed)\b') THEN 'experience' ELSE 'fact' END AS kind, count(*) AS n FROM t GROUP BY 1""",
    ),
    "fact_sentences": (
        lambda s, d: triple_facts(s, d).where("relation <> 'segment'").select("id", X.fact_sentence().alias("sentence")),
        f"WITH {TRIPLES} SELECT s || '|' || p || '|' || o AS id, s || ' ' || CASE p WHEN 'lives_in' THEN 'lives in' WHEN 'member_of' THEN 'is a member of' WHEN 'name' THEN 'is called' ELSE 'placed by' END || ' ' || o AS sentence FROM triples WHERE p <> 'segment'",
    ),
    "canonical_relations": (
        lambda s, d: facts(s, d).withColumn("relation", F.when(F.col("seq") % 2 == 0, "Employer").otherwise(F.upper("relation"))).groupBy(L.canonical_relation(F.col("relation")).alias("relation")).agg(F.count(F.lit(1)).alias("n")),
        f"WITH {FACTS} SELECT CASE WHEN seq % 2 = 0 THEN 'works_at' ELSE relation END AS relation, count(*) AS n FROM facts GROUP BY 1",
    ),
    "retire_unused": (
        lambda s, d: L.retire(M.close_intervals(facts(s, d)), "2024-01-25", 10).where("is_active").select("seq"),
        f"WITH {CHAIN} SELECT seq FROM chain WHERE is_active AND NOT coalesce(valid_to < TIMESTAMP '2024-01-15' AND access_count = 0, false)",
    ),
    "adjacent_edges": (
        lambda s, d: K.adjacent(event_edges(table(s, d, "events")), 77).select("src", "dst"),
        "WITH e AS (SELECT event_id AS src, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) SELECT src, dst FROM e WHERE dst IS NOT NULL AND (src = 77 OR dst = 77)",
    ),
    "facts_by_ids": (
        lambda s, d: S.get_facts(facts(s, d), table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"))).select("seq", "value"),
        f"WITH {FACTS} SELECT seq, value FROM facts WHERE seq IN (SELECT vec_id FROM embeddings)",
    ),
    "latest_upsert": (
        lambda s, d: S.upsert(table(s, d, "orders").select("o_orderkey", "o_totalprice", F.lit(0).alias("v")), table(s, d, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", F.lit(1.0).alias("o_totalprice"), F.lit(1).alias("v")), ["o_orderkey"], "v").select("o_orderkey", "o_totalprice"),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE o_totalprice END AS o_totalprice FROM orders",
    ),
    "nearest_labels": (
        lambda s, d: rows(s, d).select("id", F.round(A.dot(F.col("embedding"), A.literal(query(s, d))), 5).alias("dot"), F.round(A.norm(F.col("embedding")), 5).alias("norm")),
        f"WITH {E} SELECT id, round(list_dot_product(v, q), 5) AS dot, round(sqrt(list_dot_product(v, v)), 5) AS norm FROM e, q",
    ),
}
