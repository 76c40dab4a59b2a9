"""Vector queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import arrays as A
from lorekeep.operators import vectors as V
from lorekeep.sources.tables import table

E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE id = 0)"


def rows(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def query(s, d):
    return list(rows(s, d).where("id = 0").first()["embedding"])


def cells(s, d):
    index, centres = V.build_cells(rows(s, d), 10)
    return V.probe_cells(index, centres, query(s, d), 10, 4)


def quantised(s, d):
    v = rows(s, d)
    books = V.product_quantiser(v, 64, 8, 16)
    scored = v.select("id", V.pq_encode(books)("embedding").alias("code"))
    return scored.select("id", F.round(V.pq_scores(books, query(s, d))("code"), 4).alias("score")).orderBy(F.desc("score"), "id").limit(10)


def rotated(s, d):
    coded = rows(s, d).select("id", V.rotated_bits(64)("embedding").alias("code"))
    return coded.select("id", F.round(V.rotated_scores(query(s, d), 64)("code"), 4).alias("score")).orderBy(F.desc("score"), "id").limit(10)


def batched(s, d):
    return V.top_k(rows(s, d), query(s, d), 10, score=A.cosine_scores(query(s, d)))


def label_centroids(s, d):
    centre = V.centroids(rows(s, d), "label")
    return rows(s, d).join(F.broadcast(centre), "label").groupBy("label").agg(F.round(F.avg(A.cosine(F.col("embedding"), F.col("centre"))), 4).alias("spread"), F.count(F.lit(1)).alias("n"))  # one row per label


_TOP = "SELECT id, round(list_cosine_similarity(v, q), 6) AS score FROM e, q ORDER BY score DESC, id LIMIT"
QUERIES = {
    "vector_topk": (lambda s, d: V.top_k(rows(s, d), query(s, d), 10), f"WITH {E} {_TOP} 10"),
    "vector_topk_batched": (batched, f"WITH {E} {_TOP} 10"),
    "vector_topk_candidates": (
        lambda s, d: V.top_k(rows(s, d), query(s, d), 10, rows(s, d).where("label = 3").select("id")),
        f"WITH {E} SELECT id, round(list_cosine_similarity(v, q), 6) AS score FROM e, q WHERE id IN (SELECT vec_id FROM embeddings WHERE label = 3) ORDER BY score DESC, id LIMIT 10",
    ),
    "vector_cosine_pairs": (
        # every 20th vector asks, all rows answer
        lambda s, d: V.search_many(rows(s, d), rows(s, d).where("id % 20 = 0").select(F.col("id").alias("query"), "embedding"), 10).select(F.col("query").alias("a"), F.col("id").alias("b"), F.col("score").alias("cosine")),
        f"""WITH {E}, s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 20 = 0)
            SELECT a, b, round(c, 6) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) <= 10""",
    ),
    "mind_diversity": (
        lambda s, d: V.diversity(rows(s, d)),
        f"""WITH {E}, p AS (SELECT list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.id < b.id)
            SELECT round(avg(c), 5) AS mean_cosine, avg(c) > 0.85 AS uniform FROM p""",
    ),
    "int8_codec_topk": (
        lambda s, d: V.int8_top_k(V.int8(rows(s, d)), query(s, d), 10),
        f"""WITH {E}, m AS (SELECT id, v, list_max(list_transform(v, lambda x: abs(x))) / 127.0 AS scale FROM e),
            c AS (SELECT id, scale, list_transform(v, lambda x: round(x / scale)) AS code FROM m)
            SELECT id, round(list_dot_product(code, q) * scale, 6) AS score FROM c, q ORDER BY score DESC, id LIMIT 10""",
    ),
    "binary_hamming_topk": (
        lambda s, d: V.binary_top_k(rows(s, d), query(s, d), 10),
        f"""WITH {E} SELECT id, round(1 - 2 * len(list_filter(list_zip(v, q), lambda x: (x[1] > 0) <> (x[2] > 0))) / 64.0, 6) AS score FROM e, q ORDER BY score DESC, id LIMIT 10""",
    ),
    "l2_topk": (
        lambda s, d: rows(s, d).select("id", F.round(A.l2_squared(F.col("embedding"), A.literal(query(s, d))), 5).alias("distance")).orderBy("distance", "id").limit(10),
        f"WITH {E} SELECT id, round(list_sum(list_transform(list_zip(v, q), lambda x: pow(x[1] - x[2], 2))), 5) AS distance FROM e, q ORDER BY distance, id LIMIT 10",
    ),
    "label_centroids": (
        label_centroids,
        f"""WITH {E}, l AS (SELECT id, v, label FROM e JOIN embeddings ON vec_id = id), x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM l),
            c AS (SELECT label, list(s ORDER BY i) AS c FROM (SELECT label, i, sum(x) AS s FROM x GROUP BY ALL) GROUP BY label)
            SELECT label, round(avg(list_cosine_similarity(v, c)), 4) AS spread, count(*) AS n FROM l JOIN c USING (label) GROUP BY label""",
    ),
    "ivf_topk": (cells, None),
    "pq_topk": (quantised, None),
    "rotated_binary_topk": (rotated, None),
}
