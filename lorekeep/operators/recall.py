"""Recall around first hits: expansion, step distance, feedback rerank, snippets, caches, retrieval metrics."""

from __future__ import annotations

import re
from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.scoring import step_distance_boost
from lorekeep.operators.vectors import embed_text


def expand(facts: DataFrame, edges: DataFrame, hits: DataFrame, rounds: int = 2) -> DataFrame:
    """id, weight of facts around the hits: contradicted ones 0.35, earlier versions 0.3, facts about a hit's value 0.7 (then
    0.5), of the same subject 0.3.  A fact keeps its best weight; hits themselves are left out."""
    known = hits.select("id").withColumn("weight", F.lit(1.0))
    frontier = hits.select("id")
    parts = []
    for n in range(rounds):
        at = facts.join(frontier, "id", "left_semi").select(F.col("id").alias("from"), F.col("subject").alias("fs"), F.col("relation").alias("fr"), F.col("value").alias("fv"))
        contradicted = edges.where("kind = 'CONTRADICTS'").join(frontier.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"), F.lit(0.35).alias("weight"))
        versions = facts.join(at, (F.col("subject") == F.col("fs")) & (F.col("relation") == F.col("fr"))).select("id", F.lit(0.3).alias("weight"))
        onward = facts.join(at, F.col("subject") == F.col("fv")).select("id", F.lit(0.7 if n == 0 else 0.5).alias("weight"))
        beside = facts.join(at, F.col("subject") == F.col("fs")).select("id", F.lit(0.3).alias("weight"))
        found = contradicted.unionByName(versions).unionByName(onward).unionByName(beside).groupBy("id").agg(F.max("weight").alias("weight"))
        found = found.join(known.select("id"), "id", "left_anti")
        parts.append(found)
        known, frontier = known.unionByName(found), found.select("id")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reconstruct(vectors: DataFrame, edges: DataFrame, seeds: DataFrame, cosine, prune: float = 0.25, k: int = 10) -> DataFrame:
    """Seeds (id, score) and their edge neighbours, scored 0.6 cosine + 0.4 seed score, pruned by cosine, best k."""
    near = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    near = near.unionByName(edges.join(seeds.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))).distinct()
    pool = near.join(seeds, "id", "left").unionByName(seeds, allowMissingColumns=True).groupBy("id").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    scored = vectors.join(pool, "id").withColumn("cosine", cosine(F.col("embedding"))).where(F.col("cosine") >= prune)
    return scored.select("id", F.round(0.6 * F.col("cosine") + 0.4 * F.col("score"), 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def recall_step(hits: DataFrame, steps: DataFrame, current: int, window: int = 3, k: int = 10) -> DataFrame:
    """Hits (id, score) boosted by how near their step is to the current one; `steps` maps id to step."""
    boosted = hits.join(steps, "id", "left").withColumn("score", F.round(F.col("score") * F.coalesce(step_distance_boost(F.col("step"), current, window), F.lit(1.0)), 6))
    return boosted.select("id", "step", "score").orderBy(F.col("score").desc(), "id").limit(k)


def rocchio_rerank(hits: DataFrame, query: str, dims: int = 256, top: int = 3, most: int = 1000) -> DataFrame:
    """The best `most` of a result list (id, text, score) reranked: cosine with the query and with the query moved towards the
    best hits, half and half, min-max normalised and blended 0.45 / 0.55 with the list's own score.  The list is one task's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        m = np.stack([embed_text(t, dims) for t in pdf["text"]]).astype(np.float64)
        q = embed_text(query, dims).astype(np.float64)
        moved = 0.6 * q + 0.4 * m[:top].mean(axis=0)
        moved /= np.linalg.norm(moved) or 1.0

        def norm(x):
            span = x.max() - x.min()
            return np.full(x.size, 0.5) if span == 0 else (x - x.min()) / span

        near = norm(0.5 * (m @ q) + 0.5 * (m @ moved))
        return pd.DataFrame({"id": pdf["id"], "score": np.round(0.55 * norm(pdf["score"].to_numpy(float)) + 0.45 * near, 6)})

    kind = dict(hits.dtypes)["id"]
    best = hits.orderBy(F.col("score").desc(), "id").limit(most)
    return best.select("id", "text", "score", F.lit(1).alias("one")).groupBy("one").applyInPandas(run, f"id {kind}, score double")


def snippet(text: str, terms: list[str], width: int = 240) -> str:
    """The window of `width` characters that holds most different query terms, cut at word limits; the earliest of equals."""
    wanted = {t.lower() for t in terms}
    places = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w+", text) if m[0].lower() in wanted]
    if len(text) <= width or not places:
        return text[:width]
    best, at = (0, 0), 0
    for i, (start, _, _) in enumerate(places):
        inside = {w for s, e, w in places[i:] if e <= start + width}
        if len(inside) > best[0]:
            best, at = (len(inside), i), start
    left = max(0, min(at - width // 8, len(text) - width))
    if left:
        left = text.find(" ", left) + 1 or left
    right = min(len(text), left + width)
    if right < len(text):
        right = max(text.rfind(" ", left, right), left + 1)
    return ("..." if left else "") + text[left:right] + ("..." if right < len(text) else "")


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Mean recall at k and mean reciprocal rank; `ranked` has query, id, rank, `relevant` query, id."""
    first = ranked.join(relevant, ["query", "id"], "left_semi").groupBy("query").agg(F.min("rank").alias("best"), F.count_if(F.col("rank") <= k).alias("found"))
    return _means(relevant.groupBy("query").agg(F.countDistinct("id").alias("wanted")), first)


def label_metrics(ranked: DataFrame, labelled: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """As `retrieval_metrics` where the rows of a query's label (`labelled`: id, label) are relevant, itself left out.

    `queries` (query, label) are some of those rows.  No pairs of rows and queries are made: what is wanted is the label's count less one.
    """
    told = ranked.join(labelled.select("id", "label").distinct(), "id").join(queries.select("query", F.col("label").alias("asked")).distinct(), "query")
    first = told.where("label = asked").groupBy("query").agg(F.min("rank").alias("best"), F.count_if(F.col("rank") <= k).alias("found"))
    sizes = labelled.groupBy("label").agg(F.countDistinct("id").alias("n")).where("n > 1")
    return _means(queries.distinct().join(sizes, "label").select("query", (F.col("n") - 1).alias("wanted")), first)


def _means(total: DataFrame, first: DataFrame) -> DataFrame:
    per = total.join(first, "query", "left")
    return per.agg(
        F.round(F.avg(F.coalesce("found", F.lit(0)) / F.col("wanted")), 6).alias("recall_at_k"),
        F.round(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))), 6).alias("mrr"),
        F.count(F.lit(1)).alias("queries"),
    )


def rank_within(rows: DataFrame, group: str, order: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col(order).desc(), "id")))


class ResultCache:
    """Least recently used results by (user, query, table version); a user's entries go when their facts change."""

    def __init__(self, size: int = 256):
        self.size, self.rows = size, OrderedDict()

    def get(self, user: str, query: str, version: int):
        key = (user, query, version)
        if key in self.rows:
            self.rows.move_to_end(key)
            return self.rows[key]
        return None

    def put(self, user: str, query: str, version: int, value) -> None:
        self.rows[user, query, version] = value
        self.rows.move_to_end((user, query, version))
        while len(self.rows) > self.size:
            self.rows.popitem(last=False)

    def invalidate(self, user: str) -> None:
        for key in [k for k in self.rows if k[0] == user]:
            del self.rows[key]


class SemanticCache:
    """Results of the last queries, given again to a query whose vector is nearly the same, within the same scope."""

    def __init__(self, size: int = 64, least: float = 0.97, dims: int = 256):
        self.size, self.least, self.dims, self.rows = size, least, dims, []

    def get(self, scope: str, query: str):
        q = embed_text(query, self.dims)
        near = [(float(v @ q), i) for i, (s, v, _) in enumerate(self.rows) if s == scope]
        best = max(near, default=(0.0, -1))
        return self.rows[best[1]][2] if best[0] >= self.least else None

    def put(self, scope: str, query: str, value) -> None:
        self.rows.append((scope, embed_text(query, self.dims), value))
        del self.rows[: -self.size]


def prototypes(candidates: np.ndarray, target: np.ndarray, k: int = 3) -> list[tuple[int, float]]:
    """Rows of `candidates` that together explain `target` best: greedy choice, non-negative weights refitted each time."""
    gram, gain = candidates @ candidates.T, candidates @ target
    chosen: list[int] = []
    weights = np.zeros(0)
    for _ in range(min(k, len(candidates))):
        left = gain - (gram[:, chosen] @ weights if chosen else 0)
        left[chosen] = -np.inf
        best = int(np.argmax(left))
        if left[best] <= 1e-9:
            break
        chosen.append(best)
        weights = np.append(weights, 0.0)
        for _ in range(200):
            for i, c in enumerate(chosen):
                rest = gain[c] - gram[c, chosen] @ weights + gram[c, c] * weights[i]
                weights[i] = max(0.0, rest / gram[c, c])
    return [(c, float(w)) for c, w in zip(chosen, weights)]


def canonical_entities(mentions: DataFrame, aliases: DataFrame, most: int = 4) -> DataFrame:
    """(query, entity, place) of what a query's mentions (query, mention) stand for: the alias' name, else the mention itself;
    each once whatever its case, longest first, at most `most` a query.  `aliases` has alias and name, of one alias the least name counts."""
    names = aliases.groupBy(F.lower("alias").alias("alias")).agg(F.min("name").alias("name"))
    found = mentions.join(names, F.lower("mention") == F.col("alias"), "left").select("query", F.coalesce("name", "mention").alias("entity"))
    found = found.groupBy("query", F.lower("entity").alias("low")).agg(F.min("entity").alias("entity"))
    w = Window.partitionBy("query").orderBy(F.length("entity").desc(), "entity")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query", "entity", "place")


def judge(context, contains_any, also_any=None, forbidden=None):
    """How well a context answers, by nuggets: 0 with a forbidden one or without any expected, 0.5 without the second kind, else 1."""
    low = F.lower(context)
    hit = lambda words: F.exists(words, lambda w: F.contains(low, F.lower(w)))
    score = F.when((F.size(contains_any) > 0) & ~hit(contains_any), 0.0)
    if forbidden is not None:
        score = F.when(hit(forbidden), 0.0).when((F.size(contains_any) > 0) & ~hit(contains_any), 0.0)
    if also_any is not None:
        score = score.when((F.size(also_any) > 0) & ~hit(also_any), 0.5)
    return score.otherwise(1.0)


def judge_sets(rows: DataFrame, expected: str = "expected", found: str = "found") -> DataFrame:
    """With precision, recall and F1 of a found set against an expected one, and whether F1 reaches a half; an empty expectation is met."""
    both = F.size(F.array_intersect(expected, found))
    n, m = F.size(F.array_distinct(expected)), F.size(F.array_distinct(found))
    f1 = F.when(n == 0, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(2 * both / (n + m))
    return rows.withColumns({"precision": F.when(m == 0, F.lit(0.0)).otherwise(both / m), "recall": F.when(n == 0, F.lit(1.0)).otherwise(both / n), "f1": F.round(f1, 6), "met": f1 >= 0.5})
