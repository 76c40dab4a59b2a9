"""Queries of recall around first hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.catalog.graph import TRIPLES, triple_facts
from lorekeep.catalog.text import TERMS, bm25_sql, docs
from lorekeep.operators import fulltext as T
from lorekeep.operators import recall as R
from lorekeep.operators import vectors as V
from lorekeep.sources.tables import table


def expansion(s, d):
    f = triple_facts(s, d)
    none = s.createDataFrame([], "src string, dst string, kind string")
    hits = f.where("relation = 'placed_by' AND subject IN ('o1', 'o2', 'o3')").select("id")
    return R.expand(f, none, hits, 1)


def stepped(s, d):
    hits = T.bm25(docs(s, d), TERMS, 50)
    return R.recall_step(hits, docs(s, d).select("id", (F.col("id") % 20).alias("step")), 5, 3, 20)


def metrics(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    q = v.where("id % 20 = 0").select(F.col("id").alias("query"), "embedding", F.col("label").alias("ql"))  # every 20th asks, all rows answer
    ranked = V.search_many(v, q, 50)
    return R.label_metrics(ranked, v, q.select("query", F.col("ql").alias("label")), 5)


def reranked(s, d):
    hits = T.bm25(docs(s, d), TERMS, 20).join(docs(s, d).select("id", "text"), "id")
    return R.rocchio_rerank(hits, " ".join(TERMS)).orderBy(F.desc("score"), "id")


QUERIES = {
    "hit_expansion": (
        expansion,
        f"""WITH {TRIPLES}, f AS (SELECT s || '|' || p || '|' || o AS id, * FROM triples), h AS (SELECT * FROM f WHERE p = 'placed_by' AND s IN ('o1', 'o2', 'o3')),
            x AS (SELECT f.id, 0.3 AS weight FROM f JOIN h ON f.s = h.s UNION ALL SELECT f.id, 0.7 FROM f JOIN h ON f.s = h.o)
            SELECT id, CAST(max(weight) AS DOUBLE) AS weight FROM x WHERE id NOT IN (SELECT id FROM h) GROUP BY id""",
    ),
    "recall_step": (
        stepped,
        f"""WITH {bm25_sql(TERMS, 50)}, t AS (SELECT id, id % 20 AS step, score FROM b)
            SELECT id, step, round(score * CASE WHEN abs(step - 5) <= 3 THEN 1.6 ELSE 1 + 0.6 * exp(-pow(abs(step - 5) - 3, 2) / 2.0) END, 6) AS score FROM t ORDER BY score DESC, id LIMIT 20""",
    ),
    "retrieval_metrics": (
        metrics,
        """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), q AS (SELECT id AS query, e AS qe, label AS ql FROM v WHERE id % 20 = 0),
           r AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(e, qe), 6) DESC, id) AS rank FROM v JOIN q ON id <> query),
           w AS (SELECT query, id FROM v JOIN q ON label = ql AND id <> query),
           f AS (SELECT query, min(rank) AS best, count(*) FILTER (rank <= 5) AS found FROM r JOIN w USING (query, id) WHERE rank <= 50 GROUP BY query),
           n AS (SELECT query, count(*) AS wanted FROM w GROUP BY query)
           SELECT round(avg(coalesce(found, 0) / wanted), 6) AS recall_at_k, round(avg(coalesce(1.0 / best, 0)), 6) AS mrr, count(*) AS queries FROM n LEFT JOIN f USING (query)""",
    ),
    "rocchio_rerank": (reranked, None),
}
