"""Sharding by k-d tree: split at distributed weighted medians along the widest metadata dimension."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import free, fresh, local_rows, materialise

CODE_BITS, TIE_BITS = 20, 42
CODE_MAX, TIE_MASK = (1 << CODE_BITS) - 1, (1 << TIE_BITS) - 1
BINS = 4096
#: A cut stops refining once the bin it falls in weighs less than this part of a shard's target bytes.
TOLERANCE = 0.001
SLOT_BUCKET_ROWS = 50_000


@dataclass
class _Node:
    name: int
    leaves: int
    first: int  # number of the first leaf below
    dim: str = ""
    lo: int = 0
    hi: int = 0
    below: int = 0  # weight left of lo
    goal: float = 0.0
    cut: int | None = None
    children: list[_Node] = field(default_factory=list)


def _salted(narrow: DataFrame, piece: float) -> DataFrame:
    """`narrow` with a salt: 0, but a piece number from a hash of the id in groups of equal texts that outweigh `piece` bytes."""
    group = narrow.groupBy("text_hash", "size").agg(F.sum("size").alias("group_bytes"))
    big = group.where(F.col("group_bytes") > piece).select("text_hash", "size", F.ceil(F.col("group_bytes") / piece).alias("pieces"))
    # as each outweighs a fixed part of a shard, their number is bounded by that of the shards
    salted = narrow.join(F.broadcast(big), ["text_hash", "size"], "left").withColumn(
        "salt", F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).cast("int")
    )
    return salted.drop("pieces")


def shard(
    docs: DataFrame,
    shards: int | None = 24,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: tuple[str, ...] = ("source", "lang"),
    group_share: float = 0.125,
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, with shards near equal in bytes.

    A point is a group of equal texts, weighed by its bytes (UTF-8 length of the text plus 8 per row), with the
    dimensions size (log scale), id and one per category column.  The root holds all points and `shards` leaves (or
    total bytes / `target_bytes`).  Every node with more than one leaf is split along its widest dimension (range in the
    node over range in the whole) at the weighted quantile that gives each side its part of the leaves.  The quantile is
    found by repeated 4096-bin histograms of all open nodes at once: one small aggregate per pass, one row per open node
    back to the driver.  Below the code of a dimension every coordinate carries hash bits of the text, so a value that
    holds a third of the rows is still cut anywhere.

    A group of equal texts is cut into pieces of at most `group_share` of a shard's target, by a hash of the id, and each
    piece is one point: a group lighter than that is one piece and shares a shard, a heavier one may lie in several, as near
    equal shards ask.
    `slot` is gapless from 0 within a shard: ranks within (shard, hash bucket of the id) plus the bucket's offset,
    so no task holds a whole shard.

    Null and empty texts have size 8 and CRC 0; a very long text is one point, and a shard is out of balance by half a point
    at most for each level above it; a null id or category is a value of its own; ids that aren't whole numbers are placed by
    their hash; points that tie in a dimension are told apart by hash bits of the text, rows of a shard by id, size and CRC;
    repeated rows each get a slot; missing category columns are skipped, other columns never read; an empty table gives an
    empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    have = [c for c in categories if c in docs.columns]
    bits = lambda c: F.when(c.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(c).bitwiseAND(F.lit(CODE_MAX)))
    narrow = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
            *[bits(F.col(c).cast("string")).alias(f"cat{i}") for i, c in enumerate(have)],
        ),
        "shard-narrow",
    )
    integral = dict(narrow.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint")
    place = F.col("doc_id") if integral else bits(F.col("doc_id").cast("string"))
    total, rows, lo_id, hi_id = narrow.agg(F.sum("size"), F.count(F.lit(1)), F.min(place), F.max(place)).first()
    total = total or 0
    leaves = shards or max(1, ceil(total / (target_bytes or (1 << 30))))
    target = total / leaves
    salted = _salted(narrow, group_share * target) if total else narrow.withColumn("salt", F.lit(0))

    tie = F.col("text_hash").bitwiseXOR(F.xxhash64(F.col("salt"))).bitwiseAND(F.lit(TIE_MASK))
    span = max(1, (hi_id or 0) - (lo_id or 0))
    codes = {
        "d_size": F.floor(F.log2(F.col("size").cast("double")) * (CODE_MAX / 64)).cast("long"),
        "d_id": F.coalesce(F.floor((F.col("id") - F.lit(lo_id or 0)) / F.lit(float(span)) * CODE_MAX).cast("long"), F.lit(0).cast("long")),
        **{f"d_cat{i}": F.col(f"cat{i}") for i in range(len(have))},
    }
    dims = list(codes)
    points = materialise(
        salted.groupBy("text_hash", "size", "salt")
        .agg(F.sum("size").alias("w"), F.min(place).alias("id"), *[F.min(f"cat{i}").alias(f"cat{i}") for i in range(len(have))])
        .select("text_hash", "size", "salt", "w", *[(F.shiftleft(v, TIE_BITS) + tie).alias(d) for d, v in codes.items()]),
        "shard-points",
    )
    placed, written = _grow(points, dims, leaves, total, target)
    at = (
        salted.select("doc_id", "size", "text_crc32", "text_hash", "salt")
        .join(placed.select("text_hash", "size", "salt", "shard"), ["text_hash", "size", "salt"])
        .drop("text_hash", "salt")
    )
    buckets = max(1, ceil(rows / (SLOT_BUCKET_ROWS * leaves)))
    at = materialise(at.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")), "shard-rows")
    free(narrow, points, *([written] if written is not None else []))
    counts = at.groupBy("shard", "bucket").count()
    # shards x buckets rows, that is one per SLOT_BUCKET_ROWS documents; the window holds one shard's buckets
    offsets = counts.select(
        "shard",
        "bucket",
        (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).alias("before"),
    )
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32"))
    return (
        at.withColumn("rank", rank)
        .join(offsets, ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.coalesce("before", F.lit(0)) + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def shard_texts(docs: DataFrame, placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of every shard, whole: all columns of `docs` with copy, shard and slot, by the (doc_id, copy, shard, slot) of `placed`.

    `docs` has one row per id; a document that `placed` holds several times comes as often.  A null id matches null; new
    columns whose names `docs` has already get an underscore; an empty table gives an empty result.
    """
    key, names = fresh("placed_id", docs), {c: fresh(c, docs) for c in ("copy", "shard", "slot")}
    placed = placed.select(F.col("doc_id").alias(key), *[F.col(c).alias(n) for c, n in names.items()])
    return docs.join(placed, F.col(id_col).eqNullSafe(F.col(key))).drop(key)


def _grow(points: DataFrame, dims: list[str], leaves: int, total: int, target: float) -> tuple[DataFrame, DataFrame | None]:
    """Points with their shard, and the last table written on the way.  Split level by level; the driver holds one record per
    node, at most twice the number of shards."""
    placed = points.withColumn("node", F.lit(0))
    spark = points.sparkSession
    if not total:
        return placed.withColumn("shard", F.lit(0)), None
    open_nodes = [_Node(0, leaves, 0)]
    done: dict[int, int] = {} if leaves > 1 else {0: 0}
    names, whole, written = 1, None, None
    while open_nodes and leaves > 1:
        bounds = {
            r["node"]: r
            for r in placed.where(F.col("node").isin([n.name for n in open_nodes]) if len(open_nodes) < 500 else F.lit(True))
            .groupBy("node")
            .agg(F.sum("w").alias("w"), *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))])
            .collect()
        }
        whole = whole or bounds[0]
        for n in open_nodes:
            b = bounds.get(n.name)
            if b is None:  # fewer points than leaves: nothing to place here
                n.dim, n.lo, n.hi, n.cut = dims[0], 0, 0, 0
                continue

            def width(d: str, b=b) -> float:
                full = (whole[f"hi_{d}"] >> TIE_BITS) - (whole[f"lo_{d}"] >> TIE_BITS)
                return ((b[f"hi_{d}"] >> TIE_BITS) - (b[f"lo_{d}"] >> TIE_BITS)) / max(1, full)

            n.dim = max(dims, key=width)
            n.lo, n.hi, n.below, n.goal = b[f"lo_{n.dim}"], b[f"hi_{n.dim}"], 0, b["w"] * (n.leaves // 2) / n.leaves
        while seeking := [n for n in open_nodes if n.cut is None]:
            _narrow(spark, placed, dims, seeking, target)
        rules, following = [], []
        for n in open_nodes:
            left = n.leaves // 2
            for k, first in ((left, n.first), (n.leaves - left, n.first + left)):
                child = _Node(names, k, first)
                names += 1
                n.children.append(child)
                if k > 1:
                    following.append(child)
                else:
                    done[child.name] = first
            rules.append((n.name, dims.index(n.dim), n.cut, n.children[0].name, n.children[1].name))
        split = local_rows(spark, rules, ["node", "dim", "cut", "left", "right"], ["int", "int", "long", "int", "int"])
        coordinate = F.element_at(F.array(*dims), F.col("dim") + 1)
        placed = placed.join(F.broadcast(split), "node", "left").select(  # bounded by the number of shards
            "text_hash",
            "size",
            "salt",
            "w",
            *dims,
            F.when(F.col("cut").isNull(), F.col("node")).when(coordinate < F.col("cut"), F.col("left")).otherwise(F.col("right")).alias("node"),
        )
        # written once a level, so that the passes of the next level are plans of one small join each
        former, placed = written, materialise(placed, "shard-nodes")
        free(former)
        written, open_nodes = placed, following
    shards = local_rows(spark, sorted(done.items()), ["node", "shard"], ["int", "int"])
    return placed.join(F.broadcast(shards), "node"), written


def _narrow(spark, placed: DataFrame, dims: list[str], seeking: list[_Node], target: float) -> None:
    """One histogram pass: shrink each node's interval to the bin that holds its weighted quantile, or settle its cut."""
    rows = [(n.name, dims.index(n.dim), n.lo, n.hi, max(1, -(-(n.hi - n.lo + 1) // BINS)), float(n.goal - n.below)) for n in seeking]
    ask = local_rows(spark, rows, ["node", "dim", "lo", "hi", "step", "goal"], ["int", "int", "long", "long", "long", "double"])
    c = F.element_at(F.array(*dims), F.col("dim") + 1)
    histogram = (
        placed.join(F.broadcast(ask), "node")  # one row per open node, bounded by the number of shards
        .withColumn("c", c)
        .where("c between lo and hi")
        .withColumn("bin", F.expr("(c - lo) div step"))
        .groupBy("node", "bin", "goal")
        .agg(F.sum("w").alias("w"))
    )
    upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))  # at most BINS rows a node
    found = {
        r["node"]: r["b"]
        for r in histogram.withColumn("upto", upto)
        .where("upto >= goal")
        .groupBy("node")
        .agg(F.min(F.struct("bin", "upto", "w")).alias("b"))
        .collect()
    }
    step = {r[0]: r[4] for r in rows}
    for n in seeking:
        b, s = found[n.name], step[n.name]
        lo, before = n.lo + b["bin"] * s, n.below + b["upto"] - b["w"]
        if s == 1 or b["w"] <= TOLERANCE * target:
            n.cut = lo + s if n.below + b["upto"] - n.goal < n.goal - before else lo
        else:
            n.lo, n.hi, n.below = lo, lo + s - 1, before
