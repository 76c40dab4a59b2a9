"""Exact dedup by progressive refinement: byte length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import lower_az, materialise, maybe_broadcast

PREFIX_CHARS = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept (and text_sha256 with `digest`).

    Texts are equal when identical after lower-casing A-Z; the largest id of a group stays.  Three levels, each
    looking only at the rows the level before left in a group of two or more:

    1. byte length (lower-casing A-Z keeps it),
    2. xxhash64 of the first 64 characters,
    3. SHA-256 of the whole normalised text.

    Levels 1 and 2 move only (id, length, hash) rows, never text.  Level 3 reads whole texts of surviving rows only;
    with `digest` the caller wants the SHA-256 of every row, so the first scan computes it and level 3 reuses it.
    Groups are counted by map-side combined aggregates, so a group holding a third of the rows costs one row per task.

    Null text counts as empty; very long texts are hashed whole.  Rows that repeat an id are one document: they count in group_size and share `kept`.
    A null id is kept only if its whole group has null ids.  An empty table gives an empty result; other columns are
    never read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    columns = [
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).cast("long").alias("len"),
        F.xxhash64(lower_az(F.substring(text, 1, PREFIX_CHARS))).alias("prefix"),
    ]
    full = F.unhex(F.sha2(lower_az(text), 256))
    if digest:
        columns.append(full.alias("full"))
    narrow = materialise(docs.select(*columns), "dedup-narrow")

    same_length = narrow.groupBy("len").count().where("count > 1").select("len")
    by_length = narrow.join(same_length, "len", "left_semi")
    same_prefix = by_length.groupBy("len", "prefix").count().where("count > 1").select("len", "prefix")
    survivors = by_length.join(same_prefix, ["len", "prefix"], "left_semi")
    if not digest:
        ids = materialise(survivors.select("doc_id").distinct(), "dedup-survivors")
        hashed = (
            docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
            .join(maybe_broadcast(ids), "doc_id", "left_semi")
            .select("doc_id", F.octet_length("t").cast("long").alias("len"), F.unhex(F.sha2(lower_az(F.col("t")), 256)).alias("full"))
        )
        survivors = materialise(hashed, "dedup-full")
    groups = (
        survivors.groupBy("len", "full")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    if digest:
        out = narrow.join(groups, ["len", "full"], "left")
    else:
        member = survivors.join(groups, ["len", "full"]).groupBy("doc_id").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
        out = narrow.join(member, "doc_id", "left")
    keep_id = F.coalesce("keep_id", "doc_id")
    result = out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        *([F.lower(F.hex("full")).alias("text_sha256")] if digest else []),
    )
    return result
