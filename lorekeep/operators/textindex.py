"""A stored inverted index: postings with positions by term, corpus counts, and a vocabulary, from which queries are answered
without reading texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.scoring import bm25_idf, bm25_weight
from lorekeep.functions.text import simple_words
from lorekeep.functions.udf import arrow_udf
from lorekeep.scratch import free, materialise

BUCKETS = 64
#: So many tokens (or one text's) are grouped at once in a task.
TOKENS = 1_000_000


@dataclass(frozen=True)
class TextIndex:
    """An index under `path`: `postings` (batch, bucket, term, id, length, tf, positions), `counts` (n, tokens), `vocabulary` (term, n, df)."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def postings(self, terms: list[str]) -> DataFrame:
        """The postings of some terms: only their buckets' files are opened, and in those the row groups that may hold them."""
        listed = self.spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in terms]).cast("array<string>")).alias("t")).select("t", _bucket("t", self.buckets).alias("b"))
        wanted = sorted({r["b"] for r in listed.collect()})  # one row a query term
        return self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(wanted) & F.col("term").isin(terms))

    def counts(self) -> tuple[int, float]:
        r = self.spark.read.parquet(f"{self.path}/counts").agg(F.sum("n"), F.sum("tokens")).first()
        return r[0] or 0, (r[1] or 0) / (r[0] or 1)

    def vocabulary(self) -> DataFrame:
        """term, n (occurrences), df (chunks); batches added later make further rows of a term, which are summed here."""
        return self.spark.read.parquet(f"{self.path}/vocabulary").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))

    def bm25(self, terms: list[str], k: int | None = 10, k1: float = 1.5, b: float = 0.75, delta: float = 0.0) -> DataFrame:
        """id, score of the best `k` chunks for the distinct terms; ties in order of id."""
        terms = list(dict.fromkeys(terms))
        found = self.postings(terms).select("id", "term", "tf", "length")
        n, average = self.counts()
        df = {r["term"]: r["df"] for r in self.spark.read.parquet(f"{self.path}/vocabulary").where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("df").alias("df")).collect()}
        if not df:
            return found.select("id", F.lit(0.0).alias("score")).limit(0)
        idf = F.create_map(*[F.lit(x) for t, d in df.items() for x in (t, float(d))])[F.col("term")]
        weight = bm25_idf(F.lit(n), idf) * bm25_weight(F.col("tf"), F.col("length"), F.lit(average), k1, b, delta)
        scored = found.groupBy("id").agg(F.round(F.sum(weight), 6).alias("score"))
        return scored if k is None else scored.orderBy(F.col("score").desc(), "id").limit(k)

    def phrase(self, phrase: list[str], slop: int = 0) -> DataFrame:
        """id, hits.  slop 0: the words in a row; slop n: all words within n tokens of the first word's place, any order."""
        places = self.postings(list(dict.fromkeys(phrase))).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
        places = places.where(F.size("at") == len(set(phrase)))  # one entry a word of the phrase
        of = lambda w: F.element_at("at", F.lit(w))
        if not slop:
            starts = of(phrase[0])
            for i, w in enumerate(phrase[1:], 1):
                starts = F.array_intersect(starts, _moved(of(w), i))
            hits = F.size(starts)
        else:
            others = F.array(*[of(w) for w in dict.fromkeys(phrase[1:]) if w != phrase[0]]).cast("array<array<int>>")
            hits = _near(of(phrase[0]), others, F.lit(slop))
        return places.select("id", hits.alias("hits")).where("hits > 0")

    def suggest(self, prefix: str, k: int = 10) -> DataFrame:
        """The most frequent terms that begin with `prefix`; the filter reaches the vocabulary's files, which are sorted by term."""
        terms = self.spark.read.parquet(f"{self.path}/vocabulary").where(F.col("term").startswith(prefix))
        return terms.groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "term").limit(k)

    def add(self, chunks: DataFrame) -> None:
        """Index a batch of further chunks (id, text); their ids must be new."""
        _write(chunks, self.path, self.buckets)


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


@arrow_udf("int")
def _near(first: pd.Series, others: pd.Series, slop: pd.Series) -> pd.Series:
    """How many of the sorted positions `first` have one of each of `others` within `slop`; a search per position, no pairs."""

    def one(at, lists, n):
        at, held = np.asarray(at, np.int64), np.ones(len(at), bool)
        for places in lists:
            places = np.asarray(places, np.int64)
            held &= np.searchsorted(places, at + n, "right") > np.searchsorted(places, at - n, "left")
        return int(held.sum())

    return pd.Series([one(*x) for x in zip(first, others, slop)], dtype="int32")


def _bucket(term: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (id, tokens) as postings, by term: a text's tokens are all in its row, so nothing is shuffled to group them."""
    for batch in batches:
        tokens = batch.column("t")
        ends = np.concatenate([[0], np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        at = 0
        while at < len(tokens):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOKENS, "right")) - 1)
            yield from _postings(batch.column("id").slice(at, to - at), tokens.slice(at, to - at))
            at = to


def _postings(ids: pa.Array, tokens: pa.Array) -> Iterator[pa.RecordBatch]:
    lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    if not len(coded):
        return
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(coded)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    group = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(lengths) + text
    order = np.argsort(group, kind="stable")  # places stay in order
    group = group[order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    term, row = group[starts] // len(lengths), group[starts] % len(lengths)
    positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(group)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
    columns = [coded.dictionary.take(pa.array(term)), ids.take(pa.array(row)), pa.array(lengths[row].astype(np.int32)), positions]
    out = pa.RecordBatch.from_arrays(columns, ["term", "id", "length", "positions"])
    for at in range(0, len(out), 10_000):
        yield out.slice(at, 10_000)


def _write(chunks: DataFrame, path: str, buckets: int) -> None:
    spark, kind = chunks.sparkSession, chunks.schema["id"].dataType.simpleString()
    tokens = chunks.select("id", F.coalesce(simple_words(F.col("text")), F.array().cast("array<string>")).alias("t"))
    postings = tokens.mapInArrow(_grouped, f"term string, id {kind}, length int, positions array<int>")
    if not chunks.groupBy("id").count().where("count > 1").isEmpty():  # rows of one id and length are one text
        postings = postings.groupBy("term", "id", "length").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    # a frequent term is spread over all tasks by its ids, and every file is sorted by term
    spread = postings.repartition(_bucket("term", buckets), F.pmod(F.xxhash64("id"), F.lit(8)))
    spread = spread.select("term", "id", "length", F.size("positions").cast("bigint").alias("tf"), "positions", _bucket("term", buckets).alias("bucket"))
    batch = f"{path}/postings/batch=b{uuid.uuid4().hex}"
    spread.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(batch)
    # the batch's own files give its vocabulary, and that its count of tokens
    words = spark.read.schema("term string, tf bigint, bucket int").parquet(batch).groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))
    words = materialise(words, "index-words")
    words.sort("term").write.mode("append").parquet(f"{path}/vocabulary")
    chunks.agg(F.count(F.lit(1)).alias("n")).crossJoin(words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))).write.mode("append").parquet(f"{path}/counts")
    free(words)


def build(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> TextIndex:
    """Index chunks (id, text) under `path`.  Null texts have no tokens but count as chunks."""
    _write(chunks, path, buckets)
    return TextIndex(chunks.sparkSession, path, buckets)
