"""Vector kernels as column expressions, and their Arrow-batched twins for long vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions.udf import arrow_udf


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x / norm(a))


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def cosine_scores(query):
    """A UDF that scores a column of vectors against one query by a matrix product per Arrow batch."""
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in parts:
            m = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, q.size))
            lengths = np.linalg.norm(m, axis=1)
            yield pd.Series(m @ q / np.where(lengths == 0, 1.0, lengths))

    return run


@arrow_udf("array<float>")
def bundle(vectors: pd.Series) -> list[float]:
    """Grouped aggregate: the normalised sum of the group's vectors."""
    total = np.stack(vectors.to_numpy()).astype(np.float64).sum(axis=0)
    return (total / (np.linalg.norm(total) or 1.0)).astype(np.float32).tolist()


def sign_words(a: Column, dims: int) -> Column:
    """Sign bits of a vector as 64-bit words."""
    words = []
    for w in range(0, dims, 64):
        bits = [F.when(F.get(a, i) > 0, F.shiftleft(F.lit(1).cast("long"), i - w)).otherwise(F.lit(0).cast("long")) for i in range(w, min(dims, w + 64))]
        total = bits[0]
        for b in bits[1:]:
            total = total.bitwiseOR(b)
        words.append(total)
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def bit_majority(a: Column, b: Column, c: Column) -> Column:
    return a.bitwiseAND(b).bitwiseOR(a.bitwiseAND(c)).bitwiseOR(b.bitwiseAND(c))
