"""Benchmark decontamination by winnowing: fingerprints find the documents, exact windows extend the hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import lower_az, materialise, maybe_broadcast

#: A window of WINDOW words is what counts as shared.  With k-grams of GRAM words and the minimum kept of every
#: WINDOW - GRAM + 1 consecutive k-grams, any WINDOW shared words hold one whole selection window on both sides.
WINDOW, GRAM = 10, 5
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), _BREAK), "")


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _grams(words: Column, n: int) -> Column:
    """Hashes of every n consecutive words; empty below n words."""
    return F.when(
        F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))
    ).otherwise(F.array().cast("array<bigint>"))


def _winnow(grams: Column, span: int) -> Column:
    """The minimum of every `span` consecutive gram hashes, each once."""
    return F.when(
        F.size(grams) >= span,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(grams) - (span - 1)), lambda i: F.array_min(F.slice(grams, i, span)))),
    ).otherwise(F.array().cast("array<bigint>"))


def fingerprints(words: Column, short: list[int] = ()) -> Column:
    """Winnowed fingerprints of a word array, and all n-gram hashes for the lengths of benchmark items under a window."""
    winnowed = _let(words, lambda w: _let(_grams(w, GRAM), lambda g: _winnow(g, WINDOW - GRAM + 1)))
    if not short:
        return winnowed
    return _let(words, lambda w: F.array_distinct(F.concat(_let(_grams(w, GRAM), lambda g: _winnow(g, WINDOW - GRAM + 1)), *[_grams(w, n) for n in short])))


def _windows(words: Column, lengths: list[int]) -> Column:
    """array<struct<pos, len, window>> of all runs of the given lengths, pos from 0."""

    def runs(w: Column, n: int) -> Column:
        empty = F.array().cast("array<struct<pos:int,len:int,window:string>>")
        return F.when(
            F.size(w) >= n,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - n),
                lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice(w, i + 1, n), " ").alias("window")),
            ),
        ).otherwise(empty)

    return _let(words, lambda w: F.concat(*[runs(w, n) for n in lengths]))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, items (array of item ids as strings, sorted), spans (array of
    (start, end) word runs, end exclusive).

    A document word is hit if it lies in an occurrence of ten consecutive words of an item, or of a whole item that has
    fewer.  First scan: every document's winnowed fingerprints meet the benchmark's; a document with a common one is a
    candidate (shared spans of ten words always have one).  Second scan: only candidates are cut into all their windows
    and compared word for word, so hash collisions add nothing.  Fingerprints are joined inside the scan's stage as long
    as the benchmark's are small enough to broadcast (their bytes are counted), otherwise shuffled.

    Null text has no words; very long texts are read whole; repeated rows get equal results, a null id is kept; repeated items
    count once, and a window that several items share hits them all; an item without words or id never hits; empty
    tables give no hits; other columns of either table are never read.
    """
    items = materialise(
        benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("w")).where("size(w) > 0 and item is not null"),
        "leak-items",
    )
    lengths = [r[0] for r in items.select(F.least(F.size("w"), F.lit(WINDOW)).alias("n")).distinct().collect()]  # ten at most
    short = sorted(n for n in lengths if n < WINDOW)
    n_words = F.size("w").cast("long").alias("n_words")
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("t")
    )
    prints = materialise(
        items.withColumn("fp", F.explode(F.concat(fingerprints(F.col("w")), *[F.when(F.size("w") == n, _grams(F.col("w"), n)).otherwise(F.array().cast("array<bigint>")) for n in short])))
        .select("fp")
        .distinct()
        .withColumn("known", F.lit(True)),
        "leak-prints",
    )
    scanned = keyed.select("doc_id", "h", words_of(F.col("t")).alias("w")).select(
        "doc_id", "h", n_words, F.posexplode_outer(fingerprints(F.col("w"), short)).alias("pos", "fp")
    )
    found = (
        scanned.join(maybe_broadcast(prints), "fp", "left")
        .groupBy("doc_id", "h", "n_words")
        .agg(F.coalesce(F.bool_or("known"), F.lit(False)).alias("candidate"), F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("copies"))
    )
    found = materialise(found, "leak-found")
    candidates = found.where("candidate").select("doc_id", "h")
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    windows = items.withColumn("x", F.explode(_windows(F.col("w"), sorted(lengths, reverse=True) or [WINDOW]))).where(
        F.col("x.len") == F.least(F.size("w"), F.lit(WINDOW))
    )
    # a window that many items share is one row
    windows = windows.groupBy(F.col("x.len").alias("len"), F.col("x.window").alias("window")).agg(F.collect_set("item").alias("of"))
    windows = materialise(windows, "leak-windows")
    again = keyed.join(
        maybe_broadcast(candidates.withColumnsRenamed({"doc_id": "c_id", "h": "c_h"})),
        F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")),
        "left_semi",
    )
    hits = (
        again.dropDuplicates(["doc_id", "h"])
        .select("doc_id", "h", F.explode(_windows(words_of(F.col("t")), sorted(lengths) or [WINDOW])).alias("x"))
        .select("doc_id", "h", "x.pos", "x.len", "x.window")
        .join(maybe_broadcast(windows), ["len", "window"])
    )
    per_doc = hits.groupBy("doc_id", "h").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("of")))).alias("items"), F.array_sort(F.collect_set(F.struct("pos", "len"))).alias("at")
    )
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1)))))
    per_doc = per_doc.withColumn("covered", covered)
    edges = _let(
        F.col("covered"),
        lambda c: F.transform(
            F.arrays_zip(
                F.filter(c, lambda p, i: F.coalesce(F.get(c, i - 1) != p - 1, F.lit(True))).alias("start"),
                F.filter(c, lambda p, i: F.coalesce(F.get(c, i + 1) != p + 1, F.lit(True))).alias("stop"),
            ),
            lambda z: F.struct(z["start"].alias("start"), (z["stop"] + 1).alias("end")),
        ),
    )
    per_doc = per_doc.select(
        F.col("doc_id").alias("hit_id"), F.col("h").alias("hit_h"), F.size("covered").cast("long").alias("n_hit"), "items", edges.alias("spans")
    )
    return rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )
