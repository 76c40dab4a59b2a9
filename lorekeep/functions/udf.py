"""Arrow UDFs that are built on first use, so that modules import without a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import functions as F


def arrow_udf(kind: str) -> Callable:
    """Like `pandas_udf(kind)`; the function's type hints decide its shape."""

    def decorate(fn: Callable) -> Callable:
        built = []

        @wraps(fn)
        def call(*columns):
            if not built:
                built.append(F.pandas_udf(fn, kind))
            return built[0](*columns)

        return call

    return decorate
