"""Vector search, codecs, clustered index, structured encodings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import arrays as V
from lorekeep.functions.text import STOPWORDS
from lorekeep.functions.udf import arrow_udf
from lorekeep.scratch import materialise

DIM = 256


def top_k(vectors: DataFrame, query, k: int = 10, candidates: DataFrame | None = None, score=None) -> DataFrame:
    """Exact top-k by cosine: one scan, a bounded heap per task.  Ties in order of id."""
    rows = vectors if candidates is None else vectors.join(candidates.select("id"), "id", "left_semi")
    s = V.cosine(F.col("embedding"), V.literal(query)) if score is None else score(F.col("embedding"))
    return rows.select("id", F.round(s, 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def int8(vectors: DataFrame) -> DataFrame:
    """code array<int> in -127..127 and scale; code * scale restores the vector."""
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    return vectors.withColumn("scale", F.when(most == 0, F.lit(1.0)).otherwise(most / 127.0)).withColumn(
        "code", F.transform("embedding", lambda x: F.round(x.cast("double") / F.col("scale")).cast("int"))
    )


def int8_top_k(encoded: DataFrame, query, k: int = 10) -> DataFrame:
    return encoded.select("id", F.round(V.dot(F.col("code"), V.literal(query)) * F.col("scale"), 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def binary_top_k(vectors: DataFrame, query, k: int = 10) -> DataFrame:
    """Bipolar score 1 - 2 h / d of sign bits."""
    d = len(query)
    words = V.sign_words(F.col("embedding"), d)
    h = V.hamming(words, V.sign_words(V.literal(query), d))
    return vectors.select("id", F.round(1 - 2 * h / F.lit(float(d)), 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


@lru_cache(maxsize=4)
def rotation(dims: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def rotated_bits(dims: int):
    """UDF: rotate, then pack signs; with the vector's length and its share along the signs, as an unbiased estimator needs."""
    turn = rotation(dims)

    @F.pandas_udf("struct<bits:binary,length:float,along:float>")
    def run(vectors: pd.Series) -> pd.DataFrame:
        m = np.stack(vectors.to_numpy()).astype(np.float32) @ turn.T
        signs = np.where(m > 0, 1.0, -1.0) / np.sqrt(dims)
        length = np.linalg.norm(m, axis=1)
        along = (m * signs).sum(axis=1) / np.where(length == 0, 1, length)
        return pd.DataFrame({"bits": [b.tobytes() for b in np.packbits(m > 0, axis=1)], "length": length, "along": along})

    return run


def rotated_scores(query, dims: int):
    """UDF: estimated cosine of packed rotated vectors with a query."""
    q = rotation(dims) @ (np.asarray(query, np.float32) / (np.linalg.norm(query) or 1.0))

    @F.pandas_udf("double")
    def run(codes: pd.DataFrame) -> pd.Series:
        bits = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in codes["bits"]]), axis=1)[:, :dims]
        signs = (bits.astype(np.float32) * 2 - 1) / np.sqrt(dims)
        return pd.Series((signs @ q) / np.where(codes["along"].to_numpy() == 0, 1, codes["along"].to_numpy())).astype("float64")

    return run


def product_quantiser(vectors: DataFrame, dims: int, parts: int = 8, centroids: int = 16, seed: int = 5, sample: int = 20_000) -> np.ndarray:
    """Codebooks (parts, centroids, dims / parts), fitted by k-means on a bounded sample taken by hash of the id."""
    rows = vectors.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("embedding").toPandas()
    m = np.stack(rows["embedding"].to_numpy()).astype(np.float32).reshape(len(rows), parts, -1)
    rng, books = np.random.default_rng(seed), []
    for p in range(parts):
        x = m[:, p]
        c = x[rng.choice(len(x), min(centroids, len(x)), replace=False)]
        for _ in range(12):
            near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        books.append(c)
    return np.stack(books)


def pq_encode(books: np.ndarray):
    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        m = np.stack(vectors.to_numpy()).astype(np.float32).reshape(len(vectors), books.shape[0], -1)
        codes = np.stack([((m[:, p, None] - books[p][None]) ** 2).sum(axis=2).argmin(axis=1) for p in range(books.shape[0])], axis=1)
        return pd.Series([c.astype(np.uint8).tobytes() for c in codes])

    return run


def pq_scores(books: np.ndarray, query):
    """Inner products by lookup: one table per part."""
    q = np.asarray(query, np.float32).reshape(books.shape[0], -1)
    table = np.einsum("pcd,pd->pc", books, q)

    @F.pandas_udf("double")
    def run(codes: pd.Series) -> pd.Series:
        c = np.stack([np.frombuffer(b, np.uint8) for b in codes])
        return pd.Series(table[np.arange(books.shape[0])[None], c].sum(axis=1)).astype("float64")

    return run


def build_cells(vectors: DataFrame, cells: int = 16, seed: int = 3, sample: int = 100_000) -> tuple[DataFrame, np.ndarray]:
    """Inverted-file index: every vector gets the cell of its nearest centre; centres are fitted on at most `sample` rows taken by hash."""
    prepared = vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    fit_on = prepared.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample)
    model = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=8, featuresCol="features", predictionCol="cell").fit(fit_on)
    return model.transform(prepared).drop("features"), np.stack(model.clusterCenters())


def probe_cells(index: DataFrame, centres: np.ndarray, query, k: int = 10, probes: int = 4) -> DataFrame:
    """Exact cosine top-k within the cells nearest to the query."""
    q = np.asarray(query, np.float64)
    near = np.argsort(-(centres @ q) / (np.linalg.norm(centres, axis=1) * (np.linalg.norm(q) or 1.0)))[:probes]
    return top_k(index.where(F.col("cell").isin([int(c) for c in near])), query, k)


def cosine_pairs(vectors: DataFrame) -> DataFrame:
    """All pairs of a result list; callers pass top-k rows."""
    a = vectors.select(F.col("id").alias("a"), F.col("embedding").alias("va"))
    b = vectors.select(F.col("id").alias("b"), F.col("embedding").alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(V.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))


def diversity(vectors: DataFrame, limit: float = 0.85) -> DataFrame:
    """Mean pairwise cosine of a set, and whether it is suspiciously uniform.

    The cosines of all n * (n - 1) / 2 pairs add up to (|sum of unit vectors|^2 - sum of their squares) / 2, so no pair is made.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda z, x: z + x.cast("double") * x.cast("double")))
    unit = vectors.select(F.transform("embedding", lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(x.cast("double") / norm)).alias("u"))
    sums = unit.select(F.posexplode("u").alias("i", "x"), F.lit(1).alias("one")).groupBy("i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    n = F.max("n")
    mean = (F.sum(F.col("s") * F.col("s")) - F.sum("q")) / (n * (n - 1))
    return sums.agg(F.round(mean, 5).alias("mean_cosine"), (mean > limit).alias("uniform"))


def centroids(vectors: DataFrame, by: str = "label") -> DataFrame:
    """Per group the normalised sum of its vectors: added up by (group, dimension), so no task holds a group."""
    parts = vectors.select(by, F.posexplode("embedding").alias("i", "x")).groupBy(by, "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    whole = parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("c"))  # one entry a dimension
    total = F.transform("c", lambda x: x["s"])
    return whole.select(by, total.alias("total")).select(by, V.unit(F.col("total")).alias("centre"))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` highest scores, of equals the least ids; only what reaches the k-th is sorted."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        if not np.isnan(bar):
            near = np.flatnonzero(scores >= bar)
            return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 1024) -> DataFrame:
    """(query, id, score, rank): the exact cosine top-k of every query (query, embedding) among all other rows (id, embedding).

    Queries go through in blocks of `block`, numbered by a hash: one scan a block, in which every batch of rows meets the block
    as one matrix product and keeps k candidates a query, so a task hands on no more than block * k rows a batch.  Ties in order of
    id.  Null vectors match nothing.
    """
    blocks = max(1, -(-queries.count() // block))
    held = queries.where("embedding is not null").select("query", "embedding", F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block"))
    kind, out = vectors.schema["id"].dataType.simpleString(), None
    spark = vectors.sparkSession
    for b in range(blocks):
        rows = held.where(F.col("block") == b).orderBy("query").collect()  # about `block` rows
        if not rows:
            continue
        names = [r["query"] for r in rows]
        m = np.array([r["embedding"] for r in rows], np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((names, m))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, m = shared.value
            for batch in batches:
                batch = batch[batch["embedding"].notna()]
                if batch.empty:
                    continue
                v = np.array(batch["embedding"].tolist(), np.float64)
                s = np.round(m @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T, 6)
                ids = batch["id"].to_numpy()
                found = []
                for q, scores in zip(names, s):
                    order = _best(ids, scores, k + 1)
                    found += [(q, i, x) for i, x in zip(ids[order], scores[order]) if i != q][:k]
                yield pd.DataFrame(found, columns=["query", "id", "score"])

        part = vectors.select("id", "embedding").mapInPandas(run, f"query {kind}, id {kind}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"query {kind}, id {kind}, score double, rank int")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _features(text: str) -> Iterator[tuple[str, float]]:
    import re

    words = re.findall(r"[a-z0-9]+", text.lower())
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    stop = set(STOPWORDS["en"])
    for w, n in counts.items():
        yield f"w:{w}", (0.35 if w in stop else 1.0) * (1 + np.log(n))
        for size in (3, 4, 5):
            padded = f"#{w}#"
            for i in range(len(padded) - size + 1):
                yield f"c:{padded[i : i + size]}", 0.175
    for a, b in zip(words, words[1:]):
        yield f"b:{a} {b}", 0.7


@lru_cache(maxsize=1 << 15)  # the n-grams that recur; every Python worker of an executor has its own
def _slot(feature: str, dims: int) -> tuple[int, float]:
    h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
    return h % dims, 1.0 if h >> 63 else -1.0


def embed_text(text: str | None, dims: int = DIM) -> np.ndarray:
    """Signed feature hashing of words, character n-grams and bigrams, of unit length; empty text is the first axis."""
    v = np.zeros(dims)
    for feature, weight in _features(text or ""):
        i, sign = _slot(feature, dims)
        v[i] += sign * weight
    length = np.linalg.norm(v)
    if not length:
        v[0], length = 1.0, 1.0
    return (v / length).astype(np.float32)


@arrow_udf("array<float>")
def embed(texts: pd.Series) -> pd.Series:
    return texts.map(embed_text)  # as arrays: a list takes eight times their memory


@lru_cache(maxsize=64)
def role_permutation(role: str, dims: int = DIM) -> np.ndarray:
    seed = int.from_bytes(hashlib.blake2b(role.encode(), digest_size=8).digest(), "little")
    return np.random.default_rng(seed).permutation(dims)


def bind(role: str, v: np.ndarray) -> np.ndarray:
    return v[role_permutation(role, v.size)]


def unbind(role: str, v: np.ndarray) -> np.ndarray:
    return v[np.argsort(role_permutation(role, v.size))]


def bind_conv(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.fft.irfft(np.fft.rfft(a) * np.fft.rfft(b), a.size)


def unbind_conv(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.fft.irfft(np.fft.rfft(b) * np.conj(np.fft.rfft(a)), a.size)


def encode_fact(subject: str, relation: str, value: str, dims: int = DIM, plain: float = 0.3) -> np.ndarray:
    """Hologram of a fact: its parts bound to their roles, plus a share of the unbound sum."""
    s, r, v = (embed_text(x, dims) for x in (subject, relation, value))
    h = bind("subject", s) + bind("relation", r) + bind("value", v) + plain * (s + r + v)
    return (h / np.linalg.norm(h)).astype(np.float32)


@arrow_udf("array<float>")
def hologram(subject: pd.Series, relation: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([encode_fact(s or "", r or "", v or "") for s, r, v in zip(subject, relation, value)])


def working_memory(facts: DataFrame, scope: str = "user_id") -> DataFrame:
    """One normalised superposition of fact holograms per scope."""
    return facts.select(scope, hologram("subject", "relation", "value").alias("h")).groupBy(scope).agg(V.bundle("h").alias("memory"))


def extract_role(memory, role: str, vocabulary: list[str], k: int = 3) -> list[tuple[str, float]]:
    """The vocabulary entries nearest to what a memory holds in a role."""
    found = unbind(role, np.asarray(memory, np.float64))
    scored = sorted(((float(found @ embed_text(w, found.size)), w) for w in vocabulary), key=lambda x: (-x[0], x[1]))
    return [(w, s) for s, w in scored[:k]]


def hopfield_cleanup(patterns: np.ndarray, probe: np.ndarray, beta: float = 8.0, top: int = 16, steps: int = 3) -> np.ndarray:
    """A noisy vector pulled towards stored patterns by softmax attention over the nearest of them."""
    x = probe / (np.linalg.norm(probe) or 1.0)
    for _ in range(steps):
        s = patterns @ x
        near = np.argsort(-s)[:top]
        w = np.exp(beta * (s[near] - s[near].max()))
        x = (w / w.sum()) @ patterns[near]
        x /= np.linalg.norm(x) or 1.0
    return x


def integrity(vectors: DataFrame) -> DataFrame:
    """Vectors whose stored hash differs from what their content hashes to."""
    now = F.sha2(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",").cast("binary"), 256)
    return vectors.withColumn("now", now).where(F.col("vec_hash") != F.col("now"))


def missing_vectors(facts: DataFrame, vectors: DataFrame) -> DataFrame:
    return facts.join(vectors.select(F.col("fact_id").alias("id")), "id", "left_anti")


def neighbours_within(vectors: DataFrame, cells: int | None = None, k: int = 5, block: int = 1024) -> DataFrame:
    """Approximate k nearest neighbours of every vector among those of its cell: a, b, score, rank.

    Cells number about one in `block` rows (or `cells`), so their size doesn't grow with the table; a crowded cell is cut
    into blocks by hash, every pair of blocks is one group of at most 2 * block rows, and each hands on k rows a vector.
    """
    n = vectors.count()
    cells = cells or max(2, -(-n // block))
    index, _ = build_cells(vectors, cells)
    index = materialise(index.select("cell", "id", "embedding"), "cells")
    pieces = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("pieces"))
    rows = index.join(pieces, "cell").withColumn("own", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    left = rows.select("cell", F.col("own").alias("x"), every.alias("y"), "id", "embedding", F.lit(True).alias("asks"))
    right = rows.select("cell", every.alias("x"), F.col("own").alias("y"), "id", "embedding", F.lit(False).alias("asks"))
    kind = vectors.schema["id"].dataType.simpleString()

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.array(pdf["embedding"].tolist(), np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        asks, ids, found = pdf["asks"].to_numpy(bool), pdf["id"].to_numpy(), []
        s, theirs = np.round(v[asks] @ v[~asks].T, 6), ids[~asks]
        for a, scores in zip(ids[asks], s):
            order = np.lexsort((theirs, -scores))[: k + 1]
            found += [(a, b, x) for b, x in zip(theirs[order], scores[order]) if a != b][:k]
        return pd.DataFrame(found, columns=["a", "b", "score"])

    scored = left.unionByName(right).groupBy("cell", "x", "y").applyInPandas(near, f"a {kind}, b {kind}, score double")
    w = Window.partitionBy("a").orderBy(F.col("score").desc(), "b")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("a", "b", "score", "rank")


def storage_stats(vectors: DataFrame) -> DataFrame:
    """Vectors, dimensions and bytes as float32, int8 (with a scale) and sign bits."""
    d = F.size("embedding")
    return vectors.agg(
        F.count(F.lit(1)).alias("n"), F.max(d).alias("dims"), F.sum(d * 4).alias("float_bytes"), F.sum(d + 4).alias("int8_bytes"), F.sum(F.ceil(d / 8)).cast("bigint").alias("binary_bytes")
    )


def recommend_codec(tier: str) -> str:
    """The codec that suits a memory tier: exact where it is hot, small where it is archived."""
    return {"short_term": "float32", "long_term": "int8", "archive": "binary"}.get(tier, "float32")


def rebuild(facts: DataFrame, vectors: DataFrame, build, only_missing: bool = True) -> DataFrame:
    """The vector table built anew by `build` (facts to fact_id and embedding), whole or only where vectors are missing; those of
    facts that are gone are left out."""
    todo = missing_vectors(facts, vectors) if only_missing else facts
    kept = vectors.join(facts.select(F.col("id").alias("fact_id")), "fact_id", "left_semi")
    return kept.unionByName(build(todo), allowMissingColumns=True) if only_missing else build(todo)
