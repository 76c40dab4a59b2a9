"""Fuzzy line dedup: character-shingle MinHash signatures, high-recall banding, exact Jaccard, distributed union-find.

Signatures, sketches and exact sets are made in Arrow batches with numpy (the README gives the figures by which the form in
DataFrame functions alone failed); splitting, keys, buckets, joins and components are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.buckets import crossing_cells
from lorekeep.llm.common import free, fresh, hold, materialise_few, maybe_broadcast
from lorekeep.llm.components import connected_components
from lorekeep.llm.textbytes import mix

#: Lines are compared by their sets of character shingles of this length.
SHINGLE = 5
#: Signatures sample these longer shingles, which few strangers share: BANDS bands of ROWS MinHash samples.
LONG, ROWS, BANDS = 12, 2, 10
#: Lines shorter than SHORT characters also have SHORT_BANDS bands of SHORT_ROWS samples of the shingles they are compared by.
SHORT, SHORT_ROWS, SHORT_BANDS = 96, 4, 8
#: Bits of the odd sketch by which members of open buckets are sifted.
BITS = 1024
WORDS = BITS // 64
#: A bucket of about so many lines or more is cut into pieces of that size, each with a pivot of its own.
HOT = 1 << 20
#: One in so many lines tells which buckets are hot.
HOT_SAMPLE = 64
_CHUNK = 1 << 19

_rng = np.random.default_rng(20240611)
_SAMPLES = max(ROWS * BANDS, SHORT_ROWS * SHORT_BANDS)
_MULTIPLY = _rng.integers(0, 1 << 31, _SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, _SAMPLES, dtype=np.uint64).astype(np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP32 = np.uint32(0x9E3779B1)
_STEP32_4, _STEP32_8 = (np.uint32(pow(0x9E3779B1, n, 1 << 32)) for n in (4, 8))
#: Lines whose keys stand in a table of so many slots were signed by the same task before.
SEEN = 1 << 20


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), line (trimmed of blanks), one row per line; null text has no lines."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "raw")).select(
        "doc_id", "line_no", F.trim("raw").alias("line")
    )


def _points(lines: list[str]) -> np.ndarray:
    """Code points of all lines, one after the other."""
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)


def _rolling(c: np.ndarray, dtype, step) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of the 4 and 5 code points from each place (where so many follow)."""
    c = c.astype(dtype)
    two = c[:-1] * step + c[1:]
    four = two[:-2] * (np.array([step]) * step) + two[2:]  # arrays wrap around in silence
    return four, four[:-1] * step + c[4:]


def _mix32(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(16))
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def _bands(values: np.ndarray, starts: np.ndarray, rows: int, bands: int, salt: int) -> np.ndarray:
    """(sets, bands) int64: hashes of `rows` MinHash samples each, of the sets that begin at `starts`."""
    out, scaled = np.empty((starts.size, bands), np.uint64), np.empty_like(values)
    for b in range(bands):
        h = np.full(starts.size, (salt << 8) + b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            np.multiply(values, _MULTIPLY[k], out=scaled)
            np.add(scaled, _ADD[k], out=scaled)
            h = mix(h + np.minimum.reduceat(scaled, starts).astype(np.uint64) * _STEP)
        out[:, b] = h
    return out.view(np.int64)


def _inside(starts: np.ndarray, sizes: np.ndarray, width: int, n: int) -> np.ndarray:
    """Whether a shingle of `width` characters begins at each of `n` places, by the lines' starts and sizes."""
    whole = sizes >= width
    step = np.zeros(n + 1, np.int8)
    step[starts[whole]] += 1
    step[(starts + sizes)[whole] - width + 1] -= 1
    return np.cumsum(step[:n], dtype=np.int8).view(bool)


def _sets(keep: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept places, where each line's begin among them, and the lines that have some."""
    at = np.flatnonzero(keep)
    first = np.searchsorted(at, starts)
    of = np.flatnonzero(np.searchsorted(at, starts + sizes) > first)
    return at, first[of], of


def _buckets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all lines, as int64, one line after the other, and how many each has: none if it has fewer than SHINGLE
    characters, as only equal lines are like it."""
    sizes = np.fromiter((len(x) for x in lines), np.int64, len(lines))
    starts = np.cumsum(sizes) - sizes
    c = _points([*lines, " " * LONG])
    four, five = _rolling(c, np.uint32, _STEP32)
    n = c.size - LONG
    long = _mix32(four[:n] * _STEP32_8 + four[4 : n + 4] * _STEP32_4 + four[8 : n + 8])
    # half of the long shingles, the same of every line, are sample enough; a line that has only others keeps those
    half = _inside(starts, sizes, LONG, n) & (long & np.uint32(1) == 0)
    at, first, of = _sets(half, starts, sizes)
    bare = sizes >= LONG
    bare[of] = False
    if bare.any():
        at, first, of = _sets(half | _inside(starts[bare], sizes[bare], LONG, n), starts, sizes)
    short = sizes < SHORT
    at5, first5, of5 = _sets(_inside(starts[short], sizes[short], SHINGLE, n), starts, sizes)
    counts = np.zeros(len(lines), np.int64)
    counts[of] = BANDS
    behind = counts[of5]
    counts[of5] += SHORT_BANDS
    begin = np.cumsum(counts) - counts
    out = np.empty(counts.sum(), np.int64)
    if of.size:
        out[begin[of][:, None] + np.arange(BANDS)] = _bands(long[at], first, ROWS, BANDS, 1)
    if of5.size:
        out[(begin[of5] + behind)[:, None] + np.arange(SHORT_BANDS)] = _bands(_mix32(five[at5]), first5, SHORT_ROWS, SHORT_BANDS, 2)
    return out, counts


def line_bands(lines: list[str]) -> list[np.ndarray]:
    """The buckets of each line."""
    out, counts = _buckets(lines)
    return np.split(out, np.cumsum(counts)[:-1]) if lines else []


def grams(line: str) -> np.ndarray:
    """The set of character shingles, as sorted 64-bit hashes; a shorter line is one shingle."""
    c = _points([line])
    if c.size < SHINGLE:
        powers = _STEP ** np.arange(1, c.size + 1, dtype=np.uint64)
        return mix((c.astype(np.uint64) * powers).sum(keepdims=True, dtype=np.uint64) + np.uint64(c.size))
    found = np.sort(mix(_rolling(c, np.uint64, _STEP)[1]))
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if found.size > 1 else found


def _runs(column: pa.Array, size: int = _CHUNK) -> Iterator[list[str]]:
    """The column's texts in runs of about `size` characters, so that a batch of long lines doesn't fill the memory."""
    run, n = [], 0
    for at in range(0, len(column), 256):
        for t in column.slice(at, 256).to_pylist():
            run.append(t)
            n += len(t)
            if n >= size:
                yield run
                run, n = [], 0
    if run:
        yield run


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of each line; a line that repeats within a task has them once as a rule, so boilerplate is signed once a task."""
    seen = np.zeros(SEEN, np.int64)
    for batch in batches:
        at, names = 0, batch.schema.names
        rest = [n for n in names if n != "line"]
        for run in _runs(batch.column(names.index("line"))):
            keys = batch.column(names.index("k1")).slice(at, len(run)).to_numpy()
            slots = keys & (SEEN - 1)
            where = np.unique(keys, return_index=True)[1]
            where = np.sort(where[seen[slots[where]] != keys[where]])
            seen[slots] = keys
            bands, sizes = _buckets([run[i] for i in where.tolist()])
            offsets = np.zeros(len(run) + 1, np.int32)
            offsets[where + 1] = sizes
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(bands))
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(n)).slice(at, len(run)) for n in rest], lists], names=[*rest, "bands"])
            at += len(run)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, size, sketch): how many shingles, and the odd sketch: bit g mod BITS is flipped for each shingle g."""
    for batch in batches:
        sizes, words = [], []
        for t in batch.column(1):
            g = grams(t.as_py())
            sizes.append(g.size)
            words.append(np.packbits((np.bincount((g & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * WORDS), pa.array(np.concatenate([np.zeros(0, np.int64), *words])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), lists], names=["k1", "size", "sketch"])


def _near(similarity: float):
    """Of rows (a, b, la, lb) the (a, b) whose lines' sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, left = [], None, None
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = a.as_py(), b.as_py()
                if a != last:
                    last, left = a, grams(a)
                right = grams(b)
                if min(left.size, right.size) < similarity * max(left.size, right.size):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([left, right]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(common >= similarity * (left.size + right.size - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _side(sketches: DataFrame, name: str) -> DataFrame:
    """The sketches of side `name` of pairs, whose columns end in that name."""
    return sketches.select(F.col("k1").alias(name), F.col("size").alias(f"size{name}"), *[F.get("sketch", i).alias(f"s{i}{name}") for i in range(WORDS)])


def _maybe(similarity: float) -> Column:
    """Whether the sketches of sides p and q allow the similarity.

    This sieve loses no link: sets of this similarity differ in at most (1 - s) / (1 + s) of the sum of their sizes, each element
    in one of them only flips one bit, and the smaller has at least that share of the larger one's size.
    """
    differ = sum((F.bit_count(F.col(f"s{i}p").bitwiseXOR(F.col(f"s{i}q"))) for i in range(WORDS)), F.lit(0))
    limit = (F.col("sizep") + F.col("sizeq")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)
    sizes = F.least("sizep", "sizeq") >= F.greatest("sizep", "sizeq") * F.lit(similarity) - F.lit(1e-6)
    return sizes & (differ <= limit)


def _key(a: str, b: str) -> Column:
    """128 bits of a line's hashes as text."""
    return F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))


def _confirm(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The (a, b), as keys, of the pairs (p, q) of first hashes whose lines have the similarity."""
    left = texts.select(F.col("k1").alias("p"), F.col("key").alias("a"), F.col("line").alias("la")).join(maybe_broadcast(pairs), "p")
    both = left.join(texts.select(F.col("k1").alias("q"), F.col("key").alias("b"), F.col("line").alias("lb")).hint("shuffle_merge"), "q")
    return both.select("a", "b", "la", "lb").mapInArrow(_near(similarity), "a string, b string")


def _members(rows: DataFrame, *by: str) -> DataFrame:
    """Members of buckets, with the bucket's least node as `pivot`; buckets of one line that aren't pieces of larger ones are left out."""
    rows = rows.repartition(*by)
    several = "pivot < last" + " or piece > 0" * ("piece" in by)
    pivots = rows.groupBy(*by).agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where(several).drop("last")
    return rows.join(pivots.hint("shuffle_hash"), [*by])


def _shared(signed: DataFrame) -> DataFrame:
    """(band, node, pivot) of the members of buckets with several lines: one shuffle of 16 bytes a row serves their count and the join.

    The pivot is the bucket's least node.  Buckets that hold HOT lines or more, by a sample of the lines, are cut into pieces,
    so that no task holds one whole; a piece's least node is its members' pivot, and the whole's least node that of these.
    """
    member = signed.select(F.explode("bands").alias("band"), F.col("k1").alias("node"))
    seen = member.where(F.pmod("node", F.lit(HOT_SAMPLE)) == 0).groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT // HOT_SAMPLE)
    hot = materialise_few(seen.select("band", F.ceil(F.col("n") * HOT_SAMPLE / HOT).cast("int").alias("pieces")), "line-hot")
    if hot.isEmpty():
        return materialise_few(_members(member, "band").select("band", "node", "pivot"), "line-buckets", "band")
    # a row per HOT members of some bucket at most, so this side is a millionth of the members
    salted = member.join(maybe_broadcast(hot), "band", "left").select("band", "node", F.coalesce(F.pmod(F.xxhash64("node"), F.col("pieces")) + 1, F.lit(0)).cast("int").alias("piece"))
    pieces = materialise_few(_members(salted, "band", "piece"), "line-shared", "band")
    heads = pieces.where("piece > 0 and node = pivot").groupBy("band").agg(F.min("pivot").alias("top"))
    tops = pieces.where("piece > 0 and node = pivot").join(heads, "band").select("band", "node", F.col("top").alias("pivot"))
    shared = materialise_few(pieces.select("band", "node", "pivot").unionByName(tops), "line-buckets", "band")
    free(pieces)
    return shared


def line_components(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line that isn't blank: doc_id, line_no, line_class, class_size, kept.

    Lines are equal or linked when their trimmed texts' sets of 5-character shingles have Jaccard similarity of at least
    `similarity`; a class is a connected component, and its line of least (doc_id, line_no) is kept.  `line_class` is
    the least line key (128 bits in hex) in the class.

    1. One scan cuts texts into lines and signs each: bands of two MinHash samples of its 12-character shingles, and for
       short lines also of four of its 5-character ones.  Equal lines share their key, and boilerplate that fills
       a third of all lines is signed once a task.
    2. Every member of a bucket is paired with the bucket's pivot; pairs that their sketches allow (see `_maybe`) are confirmed
       on exact sets, links merged.
    3. Buckets that still hold several components are compared across them (see `crossing_cells`), sketch against sketch.
       What passes is confirmed likewise.  So no link whose lines share a bucket is lost.

    Null and empty texts have no lines to compare; blank lines belong to no class and are left out; a line of fewer than 5
    characters equals only itself; very long lines are one line, read whole; rows that repeat an id share their places and
    are kept or dropped together; a null id comes first; ties of place are kept together; an empty table gives an empty result;
    other columns are never read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    integral = kind in ("bigint", "int", "smallint", "tinyint")
    # as one decimal, (doc_id, line_no) is combined by hash aggregates; null ids come first
    place = (F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(-1 << 63).cast("decimal(20,0)")) * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no")).cast("decimal(31,0)")
    place = place if integral else F.struct("doc_id", "line_no")
    keyed = lines_of(docs).where("line <> ''").select("doc_id", "line_no", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), "line")
    signed = hold(keyed.mapInArrow(_sign, f"doc_id {kind}, line_no int, k1 bigint, k2 bigint, bands array<bigint>"))

    shared = _shared(signed)
    wanted = materialise_few(shared.select(F.col("node").alias("w")).distinct(), "line-wanted")
    texts = keyed.select("k1", "k2", "line").join(maybe_broadcast(wanted), F.col("k1") == F.col("w"), "left_semi")
    texts = materialise_few(texts.groupBy("k1", "k2").agg(F.any_value("line").alias("line")).select("k1", "k2", _key("k1", "k2").alias("key"), "line"), "line-texts")
    # pairs of first hashes; should two lines ever share one, both meet the other side
    stars = materialise_few(shared.where("node <> pivot").select(F.col("pivot").alias("p"), F.col("node").alias("q")).distinct(), "line-stars")
    sketches = texts.select("k1", "line").mapInArrow(_sketch, "k1 bigint, size bigint, sketch array<bigint>")
    sketches = materialise_few(sketches.groupBy("k1").agg(F.min("size").alias("size"), F.any_value("sketch").alias("sketch")), "line-sketches")
    # most pairs share a bucket by chance: these are sifted out before their texts are brought together
    sifted = stars.join(_side(sketches, "p").hint("shuffle_merge"), "p").join(_side(sketches, "q").hint("shuffle_merge"), "q").where(_maybe(similarity))
    sifted = materialise_few(sifted.select("p", "q"), "line-sifted", "p")
    links = materialise_few(_confirm(sifted, texts, similarity), "line-links", "a")
    component = connected_components(links, write=materialise_few)

    # from here a long stands for a line, and one for its component, which hash aggregates and sorts take cheaply
    owner = texts.join(component, F.col("key") == F.col("node")).select(F.col("k1").alias("o"), F.xxhash64("component").alias("c"))
    owner = materialise_few(owner.groupBy("o").agg(F.min("c").alias("c")), "line-owners")
    labelled = shared.select("band", "node").distinct().join(maybe_broadcast(owner), F.col("node") == F.col("o"), "left")
    marked = materialise_few(labelled.select("band", "node", F.coalesce("c", F.xxhash64(F.col("node"))).alias("component")), "line-labelled")
    split = marked.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    labelled = materialise_few(marked.join(split, "band"), "line-open")
    again = materialise_few(_across(labelled, sketches, similarity).join(sifted, ["p", "q"], "left_anti"), "line-again", "p")
    if not again.isEmpty():
        more = materialise_few(_confirm(again, texts, similarity), "line-more", "a")
        if not more.isEmpty():  # these join components, so a graph of components is enough
            of = component.select("node", "component")
            ends = more.join(of.withColumnsRenamed({"node": "a", "component": "ca"}), "a", "left").join(of.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left")
            ends = materialise_few(ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "line-ends")
            joined = connected_components(ends, "ca", "cb", materialise_few).withColumnsRenamed({"node": "old", "component": "new"})
            nodes = component.unionByName(ends.select(F.col("a").alias("node"), F.col("ca").alias("component"))).unionByName(ends.select(F.col("b").alias("node"), F.col("cb").alias("component")))
            component = nodes.distinct().join(joined, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
            component = materialise_few(component, "line-components")

    # classes are found per key; only keys of classes with several lines go back to the lines
    per_key = signed.select("k1", "k2", place.alias("place")).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    owner = materialise_few(texts.join(component, F.col("key") == F.col("node")).select("k1", "k2", "component"), "line-owner")
    free(shared, wanted, stars, sifted, links, marked, labelled, sketches, again, texts)
    named = per_key.join(maybe_broadcast(owner), ["k1", "k2"], "left").where("n > 1 or component is not null").withColumn("class", F.coalesce("component", _key("k1", "k2")))
    named = materialise_few(named.select("k1", "k2", "n", "first", "class"), "line-named")
    classes = named.groupBy("class").agg(F.sum("n").alias("class_size"), F.min("first").alias("class_first"))
    repeated = materialise_few(named.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), "class").join(classes, "class"), "line-repeated")
    free(named, owner)
    return signed.join(maybe_broadcast(repeated), (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "left").select(
        "doc_id",
        "line_no",
        F.coalesce("class", _key("k1", "k2")).alias("line_class"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.col("class_first").isNull() | (place == F.col("class_first"))).alias("kept"),
    )


def _across(labelled: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The (p, q), p < q, of different components in one bucket that may be linked by their sizes and sketches."""
    left, right = crossing_cells(labelled)

    def side(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select("band", "x", "y", F.col("node").alias(name), *[F.col(c).alias(f"{c}{name}") for c in ("component", "rest")])
        return rows.join(_side(sketches, name), name)

    once = ~F.col("restq") | (F.col("p") < F.col("q"))
    met = side(left, "p").join(side(right, "q").hint("shuffle_merge"), ["band", "x", "y"])
    met = met.where((F.col("componentp") != F.col("componentq")) & once & _maybe(similarity))
    return met.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()


def drop_repeated_lines(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the lines that aren't kept cut out of their texts; blank lines and all other columns stay.

    Null texts stay null, and a text none of whose lines is kept becomes empty; rows that repeat an id (or have none) lose the
    same line numbers; extra columns of any name are kept; an empty table gives an empty result.
    """
    key, cut = fresh("cut_id", docs), fresh("cut", docs)
    dropped = line_components(docs, similarity, id_col, text_col).where("not kept")
    per_doc = dropped.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line_no").alias(cut))  # as many as one text has lines
    lines = F.split(F.col(text_col), "\n")
    rest = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col(cut), i)), "\n")
    return (
        docs.join(per_doc, F.col(id_col).eqNullSafe(F.col(key)), "left")
        .withColumn(text_col, F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(rest))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
