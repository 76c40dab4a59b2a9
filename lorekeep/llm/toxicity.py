"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import materialise, maybe_broadcast

ORDERS = (3, 4, 5, 6, 7, 8)
#: Features are hashed into 2 ** BITS buckets, which bounds the counts, the weights and what is broadcast.  Bucket 0 holds
#: the n-grams that cross a word, which are no features.
BITS = 20
#: The linear layer is fitted on at most this many labelled documents of each class (those of smallest hashed id);
#: the log-count ratios come from every labelled document.
FIT_ROWS_PER_CLASS = 3000
#: A bucket seen in fewer labelled documents than this has ratio 0.
MIN_SUPPORT = 3
HOLD_OUT = 5


@dataclass
class Model:
    weights: np.ndarray  # float32, one per bucket: ratio times fitted coefficient
    bias: float


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts with ASCII punctuation and space as 32, four blanks around each text; starts; lengths."""
    low = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) for t in low), np.int64, len(low))
    joined = "    ".join(["", *low, ""])
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ascii_class = np.arange(128, dtype=np.uint32)
    for i in range(128):
        if not (48 <= i < 58 or 97 <= i < 123):
            ascii_class[i] = 32
    plain = c < 128
    c[plain] = ascii_class[c[plain]]
    starts = 4 + np.concatenate([[0], np.cumsum(sizes + 4)[:-1]]) if len(low) else np.zeros(0, np.int64)
    return c, starts.astype(np.int64), sizes


def _buckets(c: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each code point; 0 if a blank stands inside, not at its ends."""
    out = []
    mult = np.uint32(0x9E3779B1)
    h = c.copy()
    blanks = np.concatenate([[0], np.cumsum(c == 32, dtype=np.int32)])
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * mult + c[n - 1 :]
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            bucket = (((h + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int32)
            bucket[blanks[n - 1 : n - 1 + h.size] != blanks[1 : 1 + h.size]] = 0
            out.append(bucket)
    return out


def _features(texts: list[str], seen: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct buckets of each text.  `seen` is scratch of 2 ** BITS int32."""
    c, starts, sizes = _codes(texts)
    grams = _buckets(c)
    for s, n in zip(starts.tolist(), sizes.tolist()):
        found = np.concatenate([g[s - 1 : s + n] for g in grams])  # from the blank before the text, so word starts count
        at = np.arange(found.size, dtype=np.int32)
        seen[found] = at
        yield found[seen[found] == at]


def _chunks(texts: list[str], size: int = 2_000_000) -> Iterator[list[str]]:
    """Runs of texts of about `size` characters, so that one batch of long texts doesn't fill the memory."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t)
        if n >= size:
            yield run
            run, n = [], 0
    if run:
        yield run


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = np.zeros(1 << BITS, np.int32)
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        classes = iter(batch["toxic"].tolist())
        for run in _chunks(batch["text"].fillna("").tolist()):
            for f in _features(run, seen):
                counts[int(next(classes)), f] += 1
    counts[:, 0] = 0
    at = np.flatnonzero(counts.any(axis=0))
    for part in np.array_split(at, max(1, at.size // 100_000)):
        yield pd.DataFrame({"bucket": part.astype(np.int32), "neg": counts[0, part].astype(np.int64), "pos": counts[1, part].astype(np.int64)})


def _extract(shared):
    """For the fit: each text's distinct buckets among the telling ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, mask = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, bool)
        mask[shared.value[0]] = True
        for batch in batches:
            found = [np.sort(f[mask[f]]).astype(np.int32).tobytes() for part in _chunks(batch["text"].fillna("").tolist()) for f in _features(part, seen)]
            yield pd.DataFrame({"toxic": batch["toxic"].tolist(), "features": found})

    return run


def _telling(counts: DataFrame, n_pos: int, n_neg: int) -> DataFrame:
    """Buckets whose class split is no accident: log-likelihood ratio over 2 ln(number of buckets), which chance alone reaches in about one."""
    n, part = F.col("pos") + F.col("neg"), n_pos / (n_pos + n_neg)
    g = F.coalesce(F.col("pos") * F.ln(F.col("pos") / (n * part)), F.lit(0.0)) + F.coalesce(F.col("neg") * F.ln(F.col("neg") / (n * (1 - part))), F.lit(0.0))
    return counts.where(2 * g >= 2 * float(np.log(max(2, counts.count()))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the labelled rows whose crc32(id) mod HOLD_OUT isn't 0.

    Ratios r = log((pos + 1) / (n_pos + 2)) - log((neg + 1) / (n_neg + 2)) use document counts over all those rows,
    added up by a shuffle on the bucket.  The logistic layer over r-scaled presence features is fitted in one task on
    at most FIT_ROWS_PER_CLASS documents a class, of each of which it holds the telling buckets only, so its memory is
    bounded however long the texts are.

    An id with several labels counts as toxic if one of them is; rows without a 0/1 label or an id are not used; null and
    empty texts have no n-grams; rows that repeat a labelled id count as often as they occur; documents that tie in the
    order by which the sample is taken are told apart by their ids; with one class or none, or without documents, the model is
    the constant prior; other columns are never read.
    """
    usable = materialise(
        labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("toxic"))
        .where("l_id is not null and toxic in (0, 1)")
        .where(F.crc32(F.col("l_id").cast("string").cast("binary")) % HOLD_OUT != 0)
        .groupBy("l_id")
        .agg(F.max("toxic").alias("toxic")),
        "toxic-labels",
    )
    texts = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text"))

    def labelled(side: DataFrame) -> DataFrame:
        return texts.join(maybe_broadcast(side), F.col("d_id") == F.col("l_id"))

    size = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    n_pos, n_neg = size.get(1, 0), size.get(0, 0)
    if not n_pos or not n_neg:
        return Model(np.zeros(1 << BITS, np.float32), 4.0 if n_pos else -4.0)
    counts = materialise(
        labelled(usable)
        .select("text", "toxic")
        .mapInPandas(_count, "bucket int, neg long, pos long")
        .groupBy("bucket")
        .agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
        .where(f"neg + pos >= {MIN_SUPPORT}"),
        "toxic-counts",
    )
    telling = _telling(counts, n_pos, n_neg).select("bucket", (F.ln((F.col("pos") + 1) / (n_pos + 2)) - F.ln((F.col("neg") + 1) / (n_neg + 2))).alias("ratio")).toPandas()
    shared = docs.sparkSession.sparkContext.broadcast((telling["bucket"].to_numpy(np.int32), telling["ratio"].to_numpy(np.float32)))
    order = F.xxhash64(F.lit(3), "l_id")
    chosen = usable.where("toxic = 1").orderBy(order, "l_id").limit(FIT_ROWS_PER_CLASS).unionAll(
        usable.where("toxic = 0").orderBy(order, "l_id").limit(FIT_ROWS_PER_CLASS)
    )
    sample = labelled(materialise(chosen, "toxic-chosen")).select("text", "toxic").mapInPandas(_extract(shared), "toxic int, features binary")
    # the bounded sample is fitted in one task, which leaves the driver's memory alone
    fitted = sample.repartition(1).mapInPandas(_fit_task(shared, float(np.log(n_pos / n_neg))), "bucket int, weight double").toPandas()
    weights = np.zeros(1 << BITS, np.float32)
    inside = fitted["bucket"] >= 0
    weights[fitted["bucket"][inside]] = fitted["weight"][inside]
    return Model(weights, float(fitted["weight"][~inside].iloc[0]) if (~inside).any() else float(np.clip(np.log(n_pos / n_neg), -4, 4)))


def _fit_task(shared, prior: float):
    """The fit as a task: rows of (bucket, weight), with the intercept at bucket -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, classes = [], []
        for batch in batches:
            rows += [np.frombuffer(b, np.int32) for b in batch["features"]]
            classes += batch["toxic"].tolist()
        if not classes:
            return
        buckets, values = shared.value
        ratio = np.zeros(1 << BITS)
        ratio[buckets] = values
        model = _fit(rows, np.asarray(classes, np.float64), ratio, prior)
        at = np.flatnonzero(model.weights)
        yield pd.DataFrame({"bucket": np.append(at, -1).astype(np.int32), "weight": np.append(model.weights[at], model.bias).astype(np.float64)})

    return run


def _fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, prior: float, steps: int = 60, l2: float = 1e-3) -> Model:
    """Class-balanced logistic regression over the r-scaled features by Adagrad on the full batch; the intercept then takes the prior back in part."""
    keep = ratio != 0
    bounds = np.concatenate([[0], np.cumsum([r.size for r in rows])]).astype(np.int64)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    del rows
    if not (y == 1).any() or not (y == 0).any() or not flat.size:
        return Model(np.zeros(ratio.size, np.float32), float(np.clip(prior, -4, 4)))
    value = ratio[flat].astype(np.float32)
    scale = 1.0 / np.sqrt(max(1.0, float(np.mean(np.diff(bounds)))))
    v = np.full(ratio.size, 0.05)
    gain, bias, bias_gain = np.full(ratio.size, 1e-8), 0.0, 1e-8
    importance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    owner = np.repeat(np.arange(y.size), np.diff(bounds))
    for _ in range(steps):
        margin = np.bincount(owner, weights=value * v[flat], minlength=y.size) + bias
        g = importance * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
        grad = np.bincount(flat, weights=value * g[owner], minlength=ratio.size) + l2 * scale * v / ratio.size
        gain += grad * grad
        v -= 0.02 * grad / np.sqrt(gain)
        bias_gain += g.sum() ** 2
        bias -= 0.3 * g.sum() / np.sqrt(bias_gain)
    margin = np.bincount(owner, weights=value * v[flat], minlength=y.size) + bias
    # the intercept that separates the fitted rows best, towards the clean class as the prior says
    lo, hi = np.percentile(margin[y == 0], 99.5), np.percentile(margin[y == 1], 0.5)
    bias -= lo + 0.5 * (hi - lo) if hi > lo else np.clip(-prior, 0, 2)
    weights = np.where(keep, ratio * v, 0.0)
    spread = max(1e-6, abs(hi - lo) / 2)
    return Model((weights * (4.0 / spread if hi > lo else 1.0)).astype(np.float32), float(bias * (4.0 / spread if hi > lo else 1.0)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score in [0, 1].  Null and empty texts get the model's constant; whole texts are read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.bias))  # 2 ** BITS float32

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bias = shared.value
        seen = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            total = [float(weights[f].sum()) for part in _chunks(batch["text"].fillna("").tolist()) for f in _features(part, seen)]
            margin = np.clip(np.asarray(total, np.float64) + bias, -30, 30)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": 1 / (1 + np.exp(-margin))})

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))  # ids pass pandas as strings: exact, nulls too
    return texts.mapInPandas(run, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast(kind))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the labelled part and score all: doc_id, held_out, score, predicted, one row per input row.

    Null and empty texts get the model's constant; very long texts are scored whole, about 2 MB at a time; rows that repeat an id
    are scored each by its text; a null id is not held out; a score of exactly 0.5 counts as toxic; an empty table gives an
    empty result; other columns of either table are never read.
    """
    scored = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """`docs` without the rows scored at `cut` or above; all columns of any name kept, the text never shuffled.

    Null and empty texts get the model's constant, which is under 0.5 unless only toxic labels are known; very long texts are
    scored whole; rows that repeat an id, or have none, are judged each by its text; an empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def margin(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value
        seen = np.zeros(1 << BITS, np.int32)
        for texts in parts:
            yield pd.Series(
                [float(weights[f].sum()) + bias for run in _chunks(texts.fillna("").tolist()) for f in _features(run, seen)], dtype="float64"
            )

    limit = float(np.log(cut / (1 - cut)))
    return docs.where(margin(F.col(text_col)) < limit)
