import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, **more):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for name in ("count", "node", "key", "len", "band", "item", "size", "tokens", "h", "t", "w", "line", "place", "component", "pattern", "label"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


@pytest.fixture(scope="session")
def prose():
    """A seeded writer of invented prose."""
    rng = random.Random(5)
    words = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(1500)]

    def write(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(words) for _ in range(n))

    return write
