"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import fresh, materialise, maybe_broadcast

SEED = 7
BUCKET_ROWS = 20_000
#: Exponents tried per aggregate, which settles three steps of the bisection at once.
PROBES = 7
PASSES = 12


@dataclass
class Mixture:
    """What `temperature_mixture` settled; `sources` has a row per source: source, tokens, rows, share, weight, quota."""

    exponent: float
    budget: float
    entropy: float
    repetition: float
    sources: DataFrame


def count_tokens(text: Column) -> Column:
    """Words between spaces plus one for the end of the document, so that no document weighs nothing."""
    return (F.size(F.split(F.coalesce(text, F.lit("")), " ")) + 1).cast("long")


def _measure(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(exponent, entropy, largest weight-to-share ratio over the smallest) of each exponent, in one aggregate over the sources."""
    columns = []
    for i, a in enumerate(exponents):
        p = F.pow("share", F.lit(a))
        columns += [F.sum(p).alias(f"z{i}"), F.sum(p * F.ln("share") * a).alias(f"l{i}"), F.max(F.pow("share", F.lit(a - 1))).alias(f"m{i}"), F.min(F.pow("share", F.lit(a - 1))).alias(f"n{i}")]
    r = sources.agg(*columns).first()
    return [(a, log(r[f"z{i}"]) - r[f"l{i}"] / r[f"z{i}"], r[f"m{i}"] / r[f"n{i}"]) for i, a in enumerate(exponents)]


def _repetition(measured: tuple[float, float, float], sources: DataFrame, budget: float | None, total: float) -> float:
    if budget is None:
        return measured[2]
    r = sources.agg(F.sum(F.pow("share", F.lit(measured[0]))).alias("z"), F.max(F.pow("share", F.lit(measured[0] - 1))).alias("m")).first()
    return budget * r["m"] / (r["z"] * total)


def temperature_mixture(
    narrow: DataFrame, max_repetition: float | None = 2.0, min_entropy: float | None = None, budget_tokens: int | None = None
) -> Mixture:
    """Weights proportional to share ** exponent, with the exponent in [0, 1] bisected.

    With `min_entropy` (nats): the largest exponent whose weights reach that entropy (0, uniform, if none does).
    Otherwise the smallest exponent, hence the flattest mixture, in which no source is read more than
    `max_repetition` times.  Without `budget_tokens` the budget is the least that reads every source whole once.
    Every step is an aggregate over the per-source table; the driver sees a few numbers, never a row per source.
    """
    sources = narrow.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        empty = sources.select("source", "tokens", "rows", *[F.lit(0.0).alias(c) for c in ("share", "weight", "quota")])
        return Mixture(1.0, 0.0, 0.0, 0.0, empty)
    sources = materialise(sources.withColumn("share", F.col("tokens") / F.lit(float(total))).coalesce(8), "mix-sources")

    lo, hi = 0.0, 1.0
    for _ in range(PASSES):
        tried = [lo + (hi - lo) * (i + 1) / (PROBES + 1) for i in range(PROBES)]
        measured = _measure(sources, [0.0, *tried] if lo == 0.0 else tried)
        if min_entropy is not None:
            good = [m[1] >= min_entropy for m in measured]
            if lo == 0.0 and not good[0]:
                hi = 0.0
                break
            met = [m[0] for m, g in zip(measured, good) if g]
            lo = max([lo, *met])
            hi = min([hi, *[m[0] for m, g in zip(measured, good) if not g]])
        else:
            good = [_repetition(m, sources, budget_tokens, total) <= max_repetition for m in measured]
            if lo == 0.0 and good[0]:
                hi = 0.0
                break
            lo = max([lo, *[m[0] for m, g in zip(measured, good) if not g]])
            hi = min([hi, *[m[0] for m, g in zip(measured, good) if g]])
    exponent = lo if min_entropy is not None and hi > 0.0 else hi
    if min_entropy is not None and _measure(sources, [1.0])[0][1] >= min_entropy:
        exponent = 1.0
    (_, entropy, ratio), = _measure(sources, [exponent])
    z, most = sources.agg(F.sum(F.pow("share", F.lit(exponent))), F.max(F.pow("share", F.lit(1 - exponent)))).first()
    budget = float(budget_tokens) if budget_tokens is not None else total * z * most
    weight = F.pow("share", F.lit(exponent)) / F.lit(z)
    quota = F.round(weight * F.lit(budget), 3)
    if budget_tokens is None:  # rounding must neither cost a source its last document nor begin another epoch
        quota = F.greatest(quota, F.col("tokens").cast("double"))
    repetition = ratio if budget_tokens is None else _repetition((exponent, entropy, ratio), sources, budget_tokens, total)
    return Mixture(exponent, budget, entropy, repetition, sources.withColumn("weight", weight).withColumn("quota", quota))


def _order_key(epoch: Column, id_col: str = "doc_id") -> Column:
    return F.xxhash64(F.lit(SEED), epoch.cast("int"), F.col(id_col))


def _spread(narrow: DataFrame, mixture: Mixture) -> DataFrame:
    """Every (document, epoch) with the tokens before it in that epoch's permutation of its source.

    The permutation sorts a 64-bit hash.  A prefix sum over a whole source would sit in one task; instead ranges of the
    hash (about 20,000 documents of the largest source each) are summed apart and a small table carries the offsets.
    """
    most = mixture.sources.agg(F.max("rows")).first()[0] or 1
    bits = max(0, (most // BUCKET_ROWS).bit_length())
    sources = mixture.sources.select(F.col("source").alias("src"), F.col("tokens").alias("source_tokens"), "weight", "quota")
    epochs = F.greatest(F.lit(1), F.ceil(F.col("quota") / F.col("source_tokens"))).cast("int")
    rows = (
        narrow.join(sources, F.col("source").eqNullSafe(F.col("src")))
        .drop("src")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
        .withColumn("key", _order_key(F.col("epoch")))
        .withColumn("range", (F.shiftright("key", 64 - bits) if bits else F.lit(0)).cast("int"))
    )
    part = ["source", "epoch", "range"]
    sums = rows.groupBy(*part).agg(F.sum("tokens").alias("range_tokens"))
    offsets = sums.select(
        F.col("source").alias("o_source"),
        F.col("epoch").alias("o_epoch"),
        F.col("range").alias("o_range"),
        F.sum("range_tokens").over(Window.partitionBy("source", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
    )
    inside = F.sum("tokens").over(Window.partitionBy(*part).orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1))
    joined = rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("epoch") == F.col("o_epoch")) & (F.col("range") == F.col("o_range"))
    )
    return joined.withColumn("start", (F.coalesce("before", F.lit(0)) + F.col("inside")).cast("long"))


def _source(docs: DataFrame, source_col: str) -> Column:
    """The source as text; where the column is missing, all rows are of one null source."""
    return F.col(source_col).cast("string") if source_col in docs.columns else F.lit(None).cast("string")


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return materialise(
        docs.select(F.col(id_col).alias("doc_id"), _source(docs, source_col).alias("source"), count_tokens(F.col(text_col)).alias("tokens")),
        "mix-narrow",
    )


def mix(
    docs: DataFrame,
    max_repetition: float | None = 2.0,
    min_entropy: float | None = None,
    budget_tokens: int | None = None,
    block_tokens: int = 65_536,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixed schedule, a row per document and epoch: doc_id, source, epoch, tokens, weight, start, block, mix_key.

    A source with quota q tokens and t tokens in all is read ceil(q / t) times; each epoch is another permutation of its
    documents, and the last keeps those that start within the quota.  `block` numbers runs of `block_tokens` tokens of
    the source's stream; sorting by `mix_key` interleaves the blocks so that any prefix holds the target weights.

    A null source is a source, and so is a missing column; null or empty text is a document of two tokens (an empty word and its
    end); a text longer than a block, or than what is left of a quota, is read whole; rows that repeat an id lie side by
    side in the permutation, by their tokens; other columns are never read; without `budget_tokens` every row occurs at least once; an empty table gives an empty result.
    """
    narrow = _narrow(docs, id_col, text_col, source_col)
    mixture = temperature_mixture(narrow, max_repetition, min_entropy, budget_tokens)
    offset = F.col("epoch") * F.col("source_tokens") + F.col("start")
    block = F.floor(offset / F.lit(block_tokens))
    blocks = F.greatest(F.lit(1.0), F.col("quota") / F.lit(float(block_tokens)))
    shift = F.pmod(F.xxhash64(F.lit(SEED), "source", "block"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return (
        _spread(narrow, mixture)
        .where(offset < F.col("quota"))
        .withColumn("offset", offset.cast("long"))
        .withColumn("block", block.cast("long"))
        .select(
            "doc_id",
            "source",
            "epoch",
            "tokens",
            F.round("weight", 9).alias("weight"),
            F.col("offset").alias("start"),
            "block",
            F.round((F.col("block") + shift) / blocks, 9).alias("mix_key"),
        )
    )


def mix_rows(docs: DataFrame, max_repetition: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` with each row as often as `mix` schedules it, all columns kept and no text shuffled.

    In the last epoch of a source exactly the documents up to some hash of the permutation are read, so one small row per
    source (whole epochs, last hash) tells every document its number of copies.

    A null source, or a missing column, is one source; null and empty texts weigh two tokens; a text longer than what is
    left of a quota is still read whole; rows that tie in the permutation, as those that repeat an id, are read alike; extra
    columns of any name are kept; an empty table gives an empty result.
    """
    last_key, last_epoch, source, copy = (fresh(c, docs) for c in ("last_key", "last_epoch", "mix_source", "mix_copy"))
    narrow = _narrow(docs, id_col, text_col, source_col)
    mixture = temperature_mixture(narrow, max_repetition)
    spread = _spread(narrow, mixture)
    offset = F.col("epoch") * F.col("source_tokens") + F.col("start")
    last = F.col("epoch") == F.ceil(F.col("quota") / F.col("source_tokens")) - 1
    limits = (
        spread.groupBy("source")
        .agg(
            F.max(F.when(last & (offset < F.col("quota")), F.col("key"))).alias(last_key),
            F.max(F.when(offset < F.col("quota"), F.col("epoch"))).alias(last_epoch),
        )
        .withColumnRenamed("source", source)
    )
    limits = materialise(limits.coalesce(8), "mix-limits")
    side = maybe_broadcast(limits)
    key = _order_key(F.col(last_epoch), id_col)
    copies = F.col(last_epoch) + F.when(key <= F.col(last_key), 1).otherwise(F.when(F.col(last_epoch) == 0, 1).otherwise(0))
    return (
        docs.join(side, _source(docs, source_col).eqNullSafe(F.col(source)))
        .withColumn(copy, F.explode(F.sequence(F.lit(1), copies.cast("int"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
