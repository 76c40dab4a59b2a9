"""Near-duplicates by banded MinHash, candidates sifted with odd sketches, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import textbytes as tb
from lorekeep.llm.buckets import crossing_cells
from lorekeep.llm.common import free, fresh, materialise, maybe_broadcast
from lorekeep.llm.components import connected_components

SHINGLE = 5
#: BANDS x ROWS MinHash samples; two sets of Jaccard similarity 0.85 share no band with probability (1 - 0.85 ** 6) ** 28 = 2e-6.
BANDS, ROWS = 28, 6
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch.
BITS = 512

_rng = np.random.default_rng(20240607)
_MULTIPLY = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_SHINGLE_ODD = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SAMPLE_SALT = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_CHUNK_BYTES = 1 << 20


def _texts(column: pa.Array) -> Iterator[list[str]]:
    """The column's texts in runs of about a MB; null is empty."""
    run, size = [], 0
    for t in column.to_pylist():
        run.append(t or "")
        size += len(run[-1])
        if size >= _CHUNK_BYTES:
            yield run
            run, size = [], 0
    if run:
        yield run


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, concatenated and sorted within each text; and how many each has."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    raw = np.frombuffer(b"\n".join(parts), np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    starts, ends = tb.word_bounds(raw, tb.NON_SPACE)
    h = tb.word_hashes(tb.LOWER[raw], starts, ends)
    first = np.searchsorted(starts, begins)  # the first word of each text
    last = np.append(first[1:], starts.size)
    words = last - first
    if h.size >= SHINGLE:
        n = h.size - SHINGLE + 1
        grams = np.zeros(n, np.uint64)
        for i in range(SHINGLE):
            grams += h[i : i + n] * _SHINGLE_ODD[i]
        grams = tb.mix(grams)
    else:
        grams = np.zeros(0, np.uint64)
    sets, counts = [], np.zeros(len(texts), np.int64)
    for i, (a, b, w) in enumerate(zip(first.tolist(), last.tolist(), words.tolist())):
        if w >= SHINGLE:
            found = np.sort(grams[a : b - SHINGLE + 1])
            if found.size > 1:
                found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif w:
            found = tb.mix((h[a:b] * _SHINGLE_ODD[:w]).sum(keepdims=True, dtype=np.uint64) + np.uint64(w))
        else:
            continue
        sets.append(found)
        counts[i] = found.size
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), counts


def _keys(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """128 bits per set, as an (n, 2) array: two sums over differently mixed members, and the count."""
    one = np.add.reduceat(tb.mix(flat), starts)
    two = np.add.reduceat(tb.mix(flat ^ np.uint64(0xA5A5A5A55A5A5A5A)), starts)
    return np.stack([one, two ^ counts.astype(np.uint64)], axis=1)


def signatures(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash samples, (sets, SAMPLES) uint32: the least of an odd multiple of each member's upper half."""
    upper = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((SAMPLES, starts.size), np.uint32)
    for k in range(SAMPLES):
        out[k] = np.minimum.reduceat(upper * _MULTIPLY[k] + _ADD[k], starts)
    return out.T


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """(sets, BITS / 64) int64: each sample flips one bit, so differing samples are what a XOR of two sketches shows."""
    n = samples.shape[0]
    bit = (tb.mix(samples.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _SAMPLE_SALT) >> np.uint64(55)).astype(np.int64)
    flat = np.bincount((np.arange(n)[:, None] * BITS + bit).ravel(), minlength=n * BITS) & 1
    return np.packbits(flat.astype(np.uint8).reshape(n, BITS), axis=1).view(np.int64).reshape(n, BITS // 64)


def sketch_limit(similarity: float) -> int:
    """The most bits in which sketches of sets at `similarity` differ, short of a five sigma event."""
    differing = SAMPLES * (1 - similarity)
    differing += 5 * (SAMPLES * similarity * (1 - similarity)) ** 0.5
    expected = BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * min(differing, SAMPLES)))
    return int(expected + 2 * expected**0.5)


def _bands(samples: np.ndarray) -> np.ndarray:
    h = np.zeros((samples.shape[0], BANDS), np.uint64)
    for r in range(ROWS):
        h = tb.mix(h + samples[:, r::ROWS].astype(np.uint64) * _SHINGLE_ODD[0] + np.uint64(r + 1))
    return tb.mix(h + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _binary(keys: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), keys.shape[0], [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())]).cast(pa.binary())


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for run in _texts(batch.column(1)):
            flat, counts = shingle_sets(run)
            full = np.flatnonzero(counts)
            bands = np.zeros((len(run), BANDS), np.int64)
            sketch = np.zeros((len(run), BITS // 64), np.int64)
            keys = np.zeros((len(run), 2), np.uint64)
            if full.size:
                starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
                samples = signatures(flat, starts)
                bands[full], sketch[full], keys[full] = _bands(samples), odd_sketches(samples), _keys(flat, starts, counts[full])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, len(run)),
                    pa.array(counts),
                    _binary(keys),
                    _lists(bands.ravel(), np.full(len(run), BANDS)),
                    _lists(sketch.ravel(), np.full(len(run), BITS // 64)),
                ],
                names=["doc_id", "n_shingles", "node", "bands", "sketch"],
            )
            at += len(run)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run in _texts(batch.column(0)):
            flat, counts = shingle_sets(run)
            full = np.flatnonzero(counts)
            if full.size:
                starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
                yield pa.RecordBatch.from_arrays([_binary(_keys(flat, starts, counts[full])), _lists(flat, counts[full])], names=["node", "members"])


def _close(a: str, b: str, limit: int):
    """Native test on two sketch columns: bits that differ, at most `limit`."""
    return sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(BITS // 64)), F.lit(0)) <= limit


def _confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of `pairs` whose full sets are similar enough.

    Sets are made again from the texts of the representatives that occur in a pair, in a second scan; the ids decide
    inside the scan while their count allows a broadcast, and by a shuffle beyond.
    """
    wanted = materialise(
        pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", F.col("rep").alias("w_id")), "node"), "near-wanted"
    )
    ids = wanted.select("w_id").distinct()
    texts = docs.join(maybe_broadcast(ids), F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi").select("text")
    sets = texts.mapInArrow(_members, "node binary, members array<bigint>")
    sets = materialise(sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "near-sets")
    left = pairs.join(sets.withColumnsRenamed({"node": "a", "members": "sa"}).hint("shuffle_merge"), "a")
    both = left.join(sets.withColumnsRenamed({"node": "b", "members": "sb"}).hint("shuffle_merge"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b")


def _across(cells: tuple[DataFrame, DataFrame], sketches: DataFrame, limit: int) -> DataFrame:
    """The (a, b), a < b, of different components in one bucket whose sketches differ in at most `limit` bits."""
    left, right = cells
    left = left.join(sketches, "node").select("band", "x", "y", F.col("node").alias("p"), F.col("component").alias("cp"), F.col("sketch").alias("kp"))
    right = right.join(sketches, "node").select("band", "x", "y", F.col("node").alias("q"), F.col("component").alias("cq"), F.col("sketch").alias("kq"), F.col("rest").alias("rq"))
    once = ~F.col("rq") | (F.col("p") < F.col("q"))  # two members outside the largest component meet twice
    met = left.join(right.hint("shuffle_merge"), ["band", "x", "y"]).where((F.col("cp") != F.col("cq")) & once & _close("kp", "kq", limit))
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id reachable), kept (doc_id = component_id).

    Sets of 5-word shingles linked when 100 * |intersection| >= `percent` * |union|.

    1. One scan makes, per document, its set's 128-bit key, MinHash bands and odd sketch.  Documents of equal sets become
       one node, so a group of exact copies is one row from here on.
    2. Each bucket of a band is a star: every member is paired with the bucket's least node, so a bucket of m members
       gives m - 1 pairs.  Pairs whose odd sketches differ in too many bits are dropped (five sigma), the rest are
       confirmed on full sets, and links are merged into components.
    3. Buckets that still hold several components are compared across components: the members outside the bucket's
       largest component, in blocks of 256, with all its members, sketch against sketch; what passes is confirmed
       likewise.  So no candidate of a bucket is lost to the star, and a bucket that is one component but for a few
       strangers costs rows and comparisons in proportion to its members.

    Null, empty and blank texts have no shingles and are linked with nothing; texts are read whole, a MB at a time; repeated
    rows and rows that repeat an id share a node or keep their own sets, and a row is kept if its id is the component's;
    ties of hashes go to the least node, and of links to the smallest id; a null id never names a component unless all its
    ids are null; an empty table gives an empty result; other columns are never read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialise(
        docs.mapInArrow(_sign, f"doc_id {kind}, n_shingles bigint, node binary, bands array<bigint>, sketch array<bigint>"), "near-signed"
    )
    nodes = materialise(
        signed.where("n_shingles > 0")
        .groupBy("node")
        .agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")),
        "near-nodes",
    )
    limit = sketch_limit(percent / 100)
    member = nodes.select("node", F.explode("bands").alias("band"))
    shared = materialise(
        member.join(member.groupBy("band").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1"), "band"), "near-shared"
    )
    sketches = nodes.select("node", "sketch")

    def sifted(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(sketches.withColumnsRenamed({"node": "a", "sketch": "ka"}), "a")
        return with_a.join(sketches.withColumnsRenamed({"node": "b", "sketch": "kb"}), "b").where(_close("ka", "kb", limit)).select("a", "b")

    stars = materialise(sifted(shared.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()), "near-stars")
    links = materialise(_confirm(stars, docs, nodes, percent), "near-links")
    component = connected_components(links)

    labelled = shared.select("band", "node").join(component, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    labelled = materialise(labelled, "near-labelled")
    cells = crossing_cells(labelled)
    crossing = materialise(_across(cells, sketches, limit).join(stars, ["a", "b"], "left_anti"), "near-crossing")
    free(labelled, shared)
    if not crossing.isEmpty():
        more = materialise(_confirm(crossing, docs, nodes, percent), "near-more")
        if not more.isEmpty():
            component = connected_components(links.unionByName(more))
    named = (
        nodes.select("node", "rep")
        .join(component, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_node = named.join(names, "component").select("node", "component_id")
    component_id = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (
        signed.select("doc_id", "n_shingles", "node")
        .join(by_node, "node", "left")
        .select("doc_id", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))
    )


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document per group of near-duplicates, that of the smallest id, all columns kept.

    Rows of dropped ids go, so rows that repeat an id go or stay together; rows with null ids, which name no document, stay;
    null, empty and blank texts have no copies and stay; very long texts are compared whole; extra columns of any name
    are kept; an empty table gives an empty result.
    """
    gone = fresh("dropped", docs)
    dropped = near_duplicates(docs, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(maybe_broadcast(materialise(dropped, "near-dropped")), F.col(id_col) == F.col(gone), "left_anti")
