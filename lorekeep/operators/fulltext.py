"""Full-text retrieval over a postings table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions.scoring import bm25_idf, bm25_weight
from lorekeep.functions.text import STOPWORDS, edit_similarity, jaccard, simple_words
from lorekeep.scratch import materialise


#: So many of the most frequent tainted tokens come last in an overlap scan's order.
COMMON = 500
#: A tainted side of at most so many (token, item) cells is counted against as one array.
CELLS = 1 << 23


def tokenised(chunks: DataFrame, tokens: Column | None = None) -> DataFrame:
    return chunks.withColumn("tokens", simple_words(F.col("text")) if tokens is None else tokens)


def postings(chunks: DataFrame, tokens: Column | None = None, terms: list[str] | None = None) -> DataFrame:
    """id, term, tf, length.  With `terms`, other tokens are dropped before they are exploded, so a query's postings
    cost one narrow shuffle however long the texts are."""
    t = tokenised(chunks, tokens).select("id", F.size("tokens").alias("length"), "tokens")
    if terms is not None:
        wanted = F.array(*[F.lit(x) for x in terms])
        t = t.withColumn("tokens", F.filter("tokens", lambda x: F.array_contains(wanted, x)))
    return t.select("id", "length", F.explode("tokens").alias("term")).groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(chunks: DataFrame, tokens: Column | None = None) -> tuple[int, float]:
    r = tokenised(chunks, tokens).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("average")).first()
    return r["n"], r["average"] or 0.0


def bm25(
    chunks: DataFrame, terms: list[str], k: int | None = 10, k1: float = 1.5, b: float = 0.75, delta: float = 0.0, tokens: Column | None = None
) -> DataFrame:
    """id, score of the best `k` chunks for the distinct terms; ties in order of id."""
    terms = list(dict.fromkeys(terms))
    found = postings(chunks, tokens, terms)
    n, average = corpus_stats(chunks, tokens)
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = bm25_idf(F.lit(n), F.col("df")) * bm25_weight(F.col("tf"), F.col("length"), F.lit(average), k1, b, delta)
    scored = found.join(F.broadcast(df), "term").groupBy("id").agg(F.round(F.sum(weight), 6).alias("score"))  # one row per query term
    return scored if k is None else scored.orderBy(F.col("score").desc(), "id").limit(k)


def prf_terms(chunks: DataFrame, terms: list[str], lang: str = "en", top: int = 3, most: int = 8) -> DataFrame:
    """Terms that the best `top` hits share, by document frequency among them, then alphabetically."""
    hits = bm25(chunks, terms, top).select("id")
    stop = [*STOPWORDS[lang], *terms]
    return (
        tokenised(chunks)
        .join(F.broadcast(hits), "id", "left_semi")  # `top` rows
        .select("id", F.explode(F.array_distinct("tokens")).alias("term"))
        .where((F.length("term") > 2) & ~F.col("term").isin(stop))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .orderBy(F.col("df").desc(), "term")
        .limit(most)
    )


def phrase_search(chunks: DataFrame, phrase: list[str], slop: int = 0) -> DataFrame:
    """id, hits.  slop 0: the words in a row; slop n: all words within n tokens of the first word's place, any order."""
    t = tokenised(chunks)
    if not slop:
        line = F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" "))
        # look-ahead, so that a word may end one hit and begin the next
        hits = F.regexp_count(line, F.lit(" " + " ".join(map(re.escape, phrase)) + "(?= )"))
        return t.select("id", hits.alias("hits")).where("hits > 0")
    wanted = F.array(*[F.lit(w) for w in phrase])
    places = (
        t.select("id", F.posexplode("tokens").alias("pos", "term")).where(F.array_contains(wanted, F.col("term")))
    )
    first = places.where(F.col("term") == phrase[0]).select("id", F.col("pos").alias("at"))
    near = first.join(places.where(F.col("term") != phrase[0]), "id").where(F.abs(F.col("pos") - F.col("at")) <= slop)
    return (
        near.groupBy("id", "at")
        .agg(F.countDistinct("term").alias("terms"))
        .where(F.col("terms") == len(set(phrase)) - 1)
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("hits"))
    )


def more_like_this(chunks: DataFrame, chunk_id, k: int = 10, most_terms: int = 10, lang: str = "en") -> DataFrame:
    """BM25 by the source chunk's telling terms: rare in it first, then longest; the chunk itself left out."""
    source = chunks.where(F.col("id") == chunk_id)
    terms = (
        postings(source)
        .where((F.length("term") > 3) & ~F.col("term").isin(STOPWORDS[lang]))
        .orderBy("tf", F.length("term").desc(), "term")
        .limit(most_terms)
        .select("term")
        .collect()
    )
    return bm25(chunks.where(F.col("id") != chunk_id), [r["term"] for r in terms], k)


def vocabulary(chunks: DataFrame, min_count: int = 1) -> DataFrame:
    words = tokenised(chunks).select(F.explode("tokens").alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def suggest(chunks: DataFrame, prefix: str, k: int = 10) -> DataFrame:
    """The most frequent terms that begin with `prefix`; the filter is applied before tokens are exploded."""
    words = tokenised(chunks).select(F.explode(F.filter("tokens", lambda t: t.startswith(prefix))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "term").limit(k)


def correct_spelling(spark: SparkSession, chunks: DataFrame, queries: list[str], min_count: int = 2, most: int = 2) -> DataFrame:
    """Each query word with the nearest vocabulary word: fewest edits (at most `most`), then most frequent, then first."""
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    near = vocabulary(chunks, min_count).join(F.broadcast(asked), F.abs(F.length("term") - F.length("query")) <= most)  # the stated words
    scored = near.withColumn("edits", F.levenshtein("query", "term", most)).where("edits >= 0")
    best = scored.groupBy("query").agg(F.min(F.struct("edits", (-F.col("n")).alias("n"), "term")).alias("b"))
    return best.select("query", F.col("b.term").alias("term"), F.col("b.edits").alias("edits"))


def highlight(chunks: DataFrame, terms: list[str], before: str = "<b>", after: str = "</b>") -> DataFrame:
    """Chunks with a term as a whole word, its hits counted and marked.  Terms and marks are taken literally; longer terms first."""
    pattern = r"(?i)(?<!\w)(" + "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))) + r")(?!\w)"
    plain = [re.sub(r"([\\$])", r"\\\1", x) for x in (before, after)]
    marked = F.regexp_replace("text", pattern, f"{plain[0]}$1{plain[1]}")
    return chunks.where(F.col("text").rlike(pattern)).select("id", F.regexp_count("text", F.lit(pattern)).alias("hits"), marked.alias("marked"))


def expand_and_search(chunks: DataFrame, terms: list[str], expansions: list[list[str]], k: int = 10) -> DataFrame:
    """The primary result; only if it is empty, expanded queries at half weight, at most 2k rows."""
    primary = bm25(chunks, terms, k)
    if not primary.isEmpty():
        return primary
    out = None
    for e in expansions:
        part = bm25(chunks, e, k).withColumn("score", F.col("score") * 0.5)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return primary
    return out.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "id").limit(2 * k)


def neighbours(chunks: DataFrame, ids: DataFrame, before: int = 1, after: int = 1, session: str = "session_id", position: str = "position") -> DataFrame:
    """Chunks around the given ones within their session, with the offset."""
    centre = chunks.join(ids, "id", "left_semi").select(F.col("id").alias("centre"), F.col(session).alias("s"), F.col(position).alias("p"))
    wanted = centre.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("at", F.col("p") + F.col("offset"))
    return chunks.join(wanted, (F.col(session) == F.col("s")) & (F.col(position) == F.col("at"))).drop("s", "p", "at")


def overlap_scan(lines: DataFrame, tainted: DataFrame, threshold: float = 0.5, least_tokens: int = 4) -> DataFrame:
    """Lines whose token set overlaps a tainted line's: id, line_no, item, overlap (Jaccard).

    Sets of n tokens with this Jaccard share one of each other's first n - ceil(threshold * n) + 1 tokens in any common order, so
    only those meet through an index of the tainted side, and what meets is verified on whole sets at once.  The order puts the
    tainted side's COMMON most frequent tokens last, so that "the" is no line's prefix unless nothing else is left.

    Low thresholds leave long prefixes.  A small tainted side (CELLS) is therefore an array of tokens by items, from which a line's
    rows are added up to what it shares with every item, without a join.
    """
    ours = lines.select("id", "line_no", F.array_distinct(simple_words(F.col("line"))).alias("t")).where("size(t) > 0")
    theirs = materialise(tainted.select("item", F.array_distinct(simple_words(F.col("line"))).alias("u")).where(F.size("u") >= least_tokens), "overlap-items")
    size = theirs.select("item", F.explode("u").alias("token")).agg(F.countDistinct("token").alias("tokens"), F.countDistinct("item").alias("items")).first()
    if size["tokens"] * size["items"] <= CELLS and theirs.count() <= size["items"]:
        kinds = {c: lines.schema[c].dataType.simpleString() for c in ("id", "line_no")} | {"item": theirs.schema["item"].dataType.simpleString()}
        counted = ours.mapInArrow(_overlaps(theirs.collect(), theirs.schema["item"].dataType, threshold), ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", overlap double")
        return counted.select("id", "line_no", "item", F.round("overlap", 6).alias("overlap")).distinct()
    frequent = theirs.select(F.explode("u").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    common = [r["token"] for r in frequent.orderBy(F.desc("n"), "token").limit(COMMON).collect()][::-1]  # at most COMMON words
    late = F.array(*[F.lit(x) for x in common]).cast("array<string>")

    def prefix(t: str) -> Column:
        ordered = F.array_sort(F.transform(t, lambda x: F.struct(F.array_position(late, x).alias("late"), F.xxhash64(x).alias("h"), x.alias("token"))))
        return F.transform(F.slice(ordered, F.lit(1), F.size(t) - F.ceil(F.size(t) * F.lit(threshold) - 1e-9).cast("int") + 1), lambda x: x["token"])

    left = ours.select("id", "line_no", "t", F.explode(prefix("t")).alias("token"))
    right = theirs.select("item", "u", F.explode(prefix("u")).alias("token"))
    sizes = F.least(F.size("t"), F.size("u")) >= F.greatest(F.size("t"), F.size("u")) * F.lit(threshold) - 1e-9
    both = F.size(F.array_intersect("t", "u"))
    overlap = both / (F.size("t") + F.size("u") - both)
    met = left.join(right, "token").where(sizes).where(overlap >= threshold)
    return met.select("id", "line_no", "item", F.round(overlap, 6).alias("overlap")).distinct()


def _overlaps(items: list, kind, threshold: float):
    """Batches of (id, line_no, t) as (id, line_no, item, overlap) of pairs that reach the threshold, for rows (item, u)."""
    from pyspark.sql.pandas.types import to_arrow_type

    names, of = [r["item"] for r in items], {}
    places = [[of.setdefault(w, len(of)) for w in r["u"]] for r in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, theirs = np.zeros((len(of), len(names)), np.int32), np.array([len(p) for p in places])
        for i, p in enumerate(places):
            held[p, i] = 1
        most = max(1, (1 << 22) // max(1, len(names)))  # cells of a step, 16 MB, but for one long line
        values = pa.array(names, to_arrow_type(kind))
        for batch in batches:
            tokens = batch.column("t")
            ours = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            coded = tokens.flatten().dictionary_encode()
            known = np.array([of.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
            codes = known[coded.indices.to_numpy(zero_copy_only=False)]
            line = np.repeat(np.arange(len(ours)), ours)[codes >= 0]
            codes = codes[codes >= 0]
            starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
            ends, at, found = np.append(starts[1:], len(line)), 0, []
            while at < len(starts):
                to = max(at + 1, int(np.searchsorted(ends, starts[at] + most, "right")))
                shared = np.add.reduceat(held[codes[starts[at] : ends[to - 1]]], starts[at:to] - starts[at], axis=0)
                overlap = shared / (ours[line[starts[at:to]]][:, None] + theirs - shared)
                x, y = np.nonzero((overlap >= threshold) & (shared > 0))
                found.append((line[starts[at:to]][x], y, overlap[x, y]))
                at = to
            if found:
                x, y, overlap = (np.concatenate(part) for part in zip(*found))
                columns = [batch.column("id").take(pa.array(x)), batch.column("line_no").take(pa.array(x)), values.take(pa.array(y)), pa.array(overlap)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "line_no", "item", "overlap"])

    return run


def similar_pairs(rows: DataFrame, block: str, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """Pairs of a block whose token sets' Jaccard similarity reaches the threshold; blocks are small by nature (a session, a fact key)."""
    t = rows.select(F.col(block).alias("block"), F.col(id_col).alias("id"), F.array_distinct(simple_words(F.col(text_col))).alias("t"))
    a, b = t.withColumnsRenamed({"id": "a", "t": "ta"}), t.withColumnsRenamed({"id": "b", "t": "tb"})
    j = jaccard(F.col("ta"), F.col("tb"))
    return a.join(b, "block").where((F.col("a") < F.col("b")) & (j >= threshold)).select("block", "a", "b", F.round(j, 6).alias("similarity"))


def prefilter(candidates: DataFrame, query_terms: list[str], relations: list[str], threshold: float = 0.08, keep: int = 3) -> DataFrame:
    """Candidate triples with 0.45 term overlap + 0.45 (cosine + 1) / 2 + 0.10 relation hit over the threshold; always the best few.

    `candidates` carries a `cosine` column (0 without vectors).
    """
    terms = F.array(*[F.lit(t) for t in query_terms])
    text = F.concat_ws(" ", "subject", F.regexp_replace("relation", "_", " "), "value")
    score = 0.45 * jaccard(simple_words(text), terms) + 0.45 * (F.col("cosine") + 1) / 2 + 0.10 * F.col("relation").isin(relations).cast("double")
    ranked = candidates.withColumn("score", F.round(score, 6))
    top = ranked.orderBy(F.col("score").desc(), "id").limit(keep)
    return ranked.where(F.col("score") >= threshold).unionByName(top.where(F.col("score") < threshold))


def best_match(candidates: DataFrame, query: str, column: str = "value", least: float = 0.7) -> DataFrame:
    """The candidate of the highest fuzzy score, if it reaches `least`."""
    from lorekeep.functions.text import fuzzy_score

    return candidates.withColumn("score", F.round(fuzzy_score(F.col(column), F.lit(query)), 6)).where(F.col("score") >= least).orderBy(F.col("score").desc(), column).limit(1)


def chunk_recall(scores: DataFrame, least: float = 0.05, k: int = 8) -> DataFrame:
    """0.45 normalised BM25 + 0.55 (cosine + 1) / 2 over rows of id, bm25, cosine."""
    most = scores.agg(F.max("bm25")).first()[0] or 1.0
    score = 0.45 * F.col("bm25") / most + 0.55 * (F.col("cosine") + 1) / 2
    return scores.withColumn("score", F.round(score, 6)).where(F.col("score") >= least).orderBy(F.col("score").desc(), "id").limit(k)


def edit_neighbours(values: DataFrame, column: str, query: str, least: float) -> DataFrame:
    return values.withColumn("similarity", F.round(edit_similarity(F.col(column), F.lit(query)), 6)).where(F.col("similarity") >= least)


def rank_window(score: str = "score") -> Window:
    return Window.orderBy(F.col(score).desc(), "id")


def negation_overlap(queries: DataFrame, negations: DataFrame, least: int = 2, lang: str = "en") -> DataFrame:
    """(query, negation, shared) of negated statements that share at least `least` content words with a query: a yes to such a
    query is contradicted.  Both sides are (id, text); words meet through an index, no pair is made without one."""
    from lorekeep.functions.text import content_words

    words = lambda df, name: df.select(F.col("id").alias(name), F.explode(F.array_distinct(content_words(F.col("text"), lang))).alias("word"))
    shared = words(queries, "query").join(words(negations, "negation"), "word").groupBy("query", "negation").agg(F.count(F.lit(1)).alias("shared"))
    return shared.where(F.col("shared") >= least)


def dense_only(vectors: DataFrame, query, k: int = 10, weight: float = 0.6) -> DataFrame:
    """What a query without usable terms falls back on: every vector scanned, `weight` times its cosine."""
    from lorekeep.functions import arrays as V

    return vectors.select("id", F.round(F.lit(weight) * V.cosine(F.col("embedding"), V.literal(query)), 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def expand_prefixes(prefixes: DataFrame, terms: DataFrame, most: int = 8) -> DataFrame:
    """(prefix, term, n) of the `most` frequent dictionary terms (term, n) that begin with each prefix (prefix), of equals the first.

    A term meets a prefix by equality of its head, cut at the lengths that prefixes have, so this is no range join.
    """
    lengths = [r[0] for r in prefixes.select(F.length("prefix")).distinct().collect() if r[0]]  # as many as a word has letters
    if not lengths:
        return prefixes.select("prefix", F.lit(None).cast("string").alias("term"), F.lit(None).cast("bigint").alias("n")).limit(0)
    heads = F.array(*[F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in sorted(lengths)])
    met = terms.select("term", "n", F.explode(heads).alias("prefix")).join(prefixes.select("prefix").distinct(), "prefix")
    w = Window.partitionBy("prefix").orderBy(F.col("n").desc(), "term")
    return met.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("prefix", "term", "n")


def normalise_idiolect(texts: DataFrame, pairs: DataFrame, shared: dict[str, str], user: str = "user_id") -> DataFrame:
    """Texts with each word put as the user means it: by the user's own pairs (user, said, meant), else by the shared map.

    A user's pairs are one map (a personal dictionary), joined by user; of one word's several meanings the least counts.
    """
    own = pairs.groupBy(F.col(user).alias("p_user"), F.lower("said").alias("said")).agg(F.min("meant").alias("meant"))
    own = own.groupBy("p_user").agg(F.map_from_entries(F.collect_list(F.struct("said", "meant"))).alias("own"))
    common = F.create_map(*[F.lit(x) for kv in shared.items() for x in kv]) if shared else F.create_map().cast("map<string,string>")
    put = F.array_join(F.transform(F.split("text", " "), lambda w: F.coalesce(F.element_at("own", F.lower(w)), F.element_at(common, F.lower(w)), w)), " ")
    return texts.join(own, F.col(user) == F.col("p_user"), "left").withColumn("text", put).drop("p_user", "own")
