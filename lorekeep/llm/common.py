"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.scratch import free, hold, materialise, materialise_few, scratch_path, shared_dir

__all__ = ["documents", "free", "fresh", "hold", "local_rows", "lower_az", "materialise", "materialise_few", "maybe_broadcast", "scratch_path", "shared_dir"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A side is broadcast only when its counted bytes stay below this.
BROADCAST_BYTES = 16 << 20
#: What a row of a broadcast table takes besides its values, and a value of fixed width.
ROW_BYTES, VALUE_BYTES = 16, 8
_FIXED = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def counted_bytes(df: DataFrame) -> int:
    """The bytes of a written table: rows, values of fixed width, and the lengths of all texts, arrays and the like."""
    fixed = ROW_BYTES + VALUE_BYTES * sum(t in _FIXED or t.startswith("decimal") for _, t in df.dtypes)
    wide = [F.sum(F.octet_length(F.col(f"`{c}`") if t in ("string", "binary") else F.col(f"`{c}`").cast("string"))) for c, t in df.dtypes if t not in _FIXED and not t.startswith("decimal")]
    n, *sums = df.agg(F.count(F.lit(1)), *wide).first()
    return n * fixed + sum(s or 0 for s in sums)


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast the written table `df` only when its counted bytes are under the bound; otherwise leave the join to shuffle."""
    return F.broadcast(df) if counted_bytes(df) <= BROADCAST_BYTES else df.hint("shuffle_merge")


def fresh(name: str, *dfs: DataFrame) -> str:
    """`name`, with as many underscores behind it as keep it apart from all columns of `dfs`."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def local_rows(spark: SparkSession, rows: list[tuple], names: list[str], types: list[str]) -> DataFrame:
    """A small relation of numbers, handed over as one Arrow table that becomes a local relation of the plan."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], kinds[t]) for i, (n, t) in enumerate(zip(names, types))}))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
