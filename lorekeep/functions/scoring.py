"""Scores: retention, fading, step distance, BM25 parts, fusion weights."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_days(since: Column, now: str) -> Column:
    return (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(since)) / F.lit(86400.0)


def retention(now: str, chain_updates: Column | None = None) -> Column:
    """How well a fact is remembered: confidence, a square-root forgetting curve, use, and interference by later versions."""
    age = F.greatest(age_days(F.col("valid_from"), now), F.lit(0.0))
    use = 1 + 0.5 * (F.col("reinforcement") - 1) + 0.1 * F.least(F.col("access_count"), F.lit(20))
    updates = F.lit(0) if chain_updates is None else chain_updates
    return F.col("confidence") * F.pow(1 + age / 30.0, F.lit(-0.5)) * use / (1 + 0.25 * updates)


def fade(now: str, chain_updates: Column | None = None, decay: float = 0.05) -> Column:
    age = F.greatest(age_days(F.col("valid_from"), now), F.lit(0.0))
    updates = F.lit(0) if chain_updates is None else chain_updates
    return (
        retention(now, chain_updates)
        * F.exp(-decay * age)
        * (1 + F.least(0.5 * F.col("access_count"), F.lit(2.5)))
        * F.greatest(F.lit(0.1), 1 - 0.25 * updates)
    )


def step_distance_boost(step: Column, current: int, window: int, edge: int | None = None) -> Column:
    """1.6 within `edge` steps of the current one, then falling like a bell curve to 1."""
    edge = window if edge is None else edge
    sigma = max(1.0, window / 3.0)
    distance = F.abs(step - F.lit(current)).cast("double")
    return F.when(distance <= edge, F.lit(1.6)).otherwise(1 + 0.6 * F.exp(-F.pow(distance - edge, F.lit(2.0)) / (2 * sigma * sigma)))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, length: Column, average: Column, k1: float = 1.5, b: float = 0.75, delta: float = 0.0) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average)) + delta


def attenuate(weight: float, rounds: int) -> float:
    return weight * exp(-rounds)


def min_max(value: Column, window, constant: float = 0.5) -> Column:
    lo, hi = F.min(value).over(window), F.max(value).over(window)
    return F.when(hi == lo, F.lit(constant)).otherwise((value - lo) / (hi - lo))
