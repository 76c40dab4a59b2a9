"""Query planning: intent of a question, candidate retrieval, fused search, result rendering."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.dates import find_dates
from lorekeep.functions.text import fact_sentence, rewrite_query, sanitise_query
from lorekeep.operators import fulltext, fusion, graph, vectors
from lorekeep.operators.temporal import diversify
from lorekeep.sources.tables import scope_filter

RELATION_WORDS = {
    "works_at": "work works worked job employer company employed", "lives_in": "live lives lived home city reside residence", "likes": "like likes love enjoy", "dislikes": "hate dislike", "role": "role title position occupation", "reports_to": "manager boss report reports supervisor", "name": "name called", "spouse": "wife husband spouse partner married", "birthday": "birthday born", "skill": "skill skills know language", "pet": "pet dog cat", "visited": "visit visited trip travelled", "member_of": "team group member", "owns": "own owns car bought",
}


@dataclass
class Plan:
    """What a question asks for."""

    query: str
    terms: list[str]
    variants: list[str]
    relations: list[str]
    entities: list[str]
    window: tuple[str, str] | None = None
    intents: set[str] = field(default_factory=set)


def plan(query: str, today: date | None = None) -> Plan:
    low = query.lower()
    terms = sanitise_query(query)
    intents = set()
    if re.search(r"\b(how many|count|number of)\b", low):
        intents.add("count")
    if re.search(r"\b(first|then|order|sequence|before or after|earlier|later)\b", low):
        intents.add("ordering")
    if re.search(r"\b(list|all|which|everything|every)\b", low):
        intents.add("list")
    if re.search(r"\b(now|current|currently|still|these days|today)\b", low):
        intents.add("current")
    if re.search(r"\b(used to|previously|former|history|changed|over time)\b", low):
        intents.add("history")
    if re.search(r"\b(whose|manager of|boss of|wife of|husband of|friend of)\b", low):
        intents.add("multihop")
    dates = find_dates(query, today or date.today())
    window = None
    if dates:
        intents.add("temporal")
        day = date.fromisoformat(dates[0][2])
        end = {"day": day, "week": day, "month": date(day.year + day.month // 12, day.month % 12 + 1, 1), "year": date(day.year + 1, 1, 1)}[dates[0][4]]
        window = (day.isoformat(), end.isoformat())
    relations = [r for r, words in RELATION_WORDS.items() if set(words.split()) & set(terms)]
    entities = re.findall(r"\b[A-Z][a-zA-Z]+(?:\s[A-Z][a-zA-Z]+)*", query[:1].lower() + query[1:])
    return Plan(query, terms, rewrite_query(query), relations, entities, window, intents)


def symbolic(facts: DataFrame, p: Plan) -> DataFrame:
    """Facts the plan points at, scored by what matched: relation, entity, current, window."""
    names = [e.lower() for e in p.entities]
    score = F.lit(0.0)
    if p.relations:
        score = score + F.when(F.col("relation").isin(p.relations), 1.0).otherwise(0.0)
    if names:
        score = score + F.when(F.lower("subject").isin(names) | F.lower("value").isin(names), 0.8).otherwise(0.0)
    if p.window:
        lo, hi = (F.lit(x).cast("timestamp") for x in p.window)
        score = score + F.when((F.col("valid_from") <= hi) & (F.col("valid_to").isNull() | (F.col("valid_to") >= lo)), 0.5).otherwise(0.0)
    scored = facts.withColumn("score", score).where("score > 0")
    if "current" in p.intents:
        scored = scored.withColumn("score", F.col("score") + F.when(F.col("valid_to").isNull() & F.col("is_active"), 0.3).otherwise(0.0))
    return scored.select("id", F.round("score", 6).alias("score"))


def search(facts: DataFrame, query: str, user_id: str, agent_id: str | None = None, k: int = 10, today: date | None = None, seeds: int = 50, stored: DataFrame | None = None) -> DataFrame:
    """Hybrid search of one scope: symbolic hits, BM25 over fact sentences, a graph walk and vectors, fused by reciprocal rank,
    then at most four rows of a relation before the others.  Every list is a top-k, so fusion works on a few hundred rows.

    `stored` (fact_id, embedding) holds the facts' vectors as `vectors.embed` makes them of fact sentences; without it
    the scope's sentences are embedded on the way.
    """
    p = plan(query, today)
    mine = scope_filter(facts, user_id, agent_id).where(~F.col("quarantined"))
    if "history" not in p.intents and "temporal" not in p.intents:
        mine = mine.where("is_active")
    texts = mine.select("id", fact_sentence().alias("text"))
    lists = [symbolic(mine, p).orderBy(F.col("score").desc(), "id").limit(seeds)]
    if p.terms:
        lists.append(fulltext.bm25(texts, p.terms, seeds))
        lists.append(graph.entity_walk(mine, p.terms, seeds).orderBy(F.col("score").desc(), "id").limit(seeds))
        held = texts.select("id", vectors.embed("text").alias("embedding")) if stored is None else mine.select("id").join(stored.select(F.col("fact_id").alias("id"), "embedding"), "id")
        lists.append(vectors.top_k(held, vectors.embed_text(query).tolist(), seeds))
    fused = fusion.rrf(lists)
    hits = mine.join(F.broadcast(fused), "id")  # at most 4 * seeds rows
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "subject", "relation", "value", "id")))
    return diversify(ranked, k)


def history_notes(facts: DataFrame, user_id: str) -> DataFrame:
    """Per (subject, relation) with changes: the ordered values with the current one marked."""
    mine = scope_filter(facts, user_id)
    one = F.concat("value", F.when(F.col("valid_to").isNull(), " (current)").otherwise(F.concat(F.lit(" (until "), F.date_format("valid_to", "yyyy-MM-dd"), F.lit(")"))))
    chain = mine.groupBy("subject", "relation").agg(F.sort_array(F.collect_list(F.struct("valid_from", "id", one.alias("t")))).alias("c"), F.countDistinct("value").alias("n"))
    return chain.where("n > 1").select("subject", "relation", (F.col("n") - 1).alias("changes"), F.array_join(F.transform("c", lambda x: x["t"]), " -> ").alias("note"))


def as_lines(hits: DataFrame) -> DataFrame:
    return hits.select("id", F.concat_ws(" | ", "subject", "relation", "value").alias("line"))


def as_ntriples(facts: DataFrame, base: str = "urn:lore:") -> DataFrame:
    safe = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]+", "_")
    literal = F.regexp_replace(F.regexp_replace("value", r"\\", r"\\\\\\\\"), '"', '\\\\\\\\"')
    return facts.select("id", F.concat(F.lit(f"<{base}"), safe("subject"), F.lit(f"> <{base}"), safe("relation"), F.lit('> "'), literal, F.lit('" .')).alias("line"))


def as_datalog(facts: DataFrame) -> DataFrame:
    quoted = lambda c: F.concat(F.lit("'"), F.regexp_replace(c, "'", "''"), F.lit("'"))
    return facts.select("id", F.concat(F.regexp_replace(F.lower("relation"), r"[^a-z0-9_]+", "_"), F.lit("("), quoted("subject"), F.lit(", "), quoted("value"), F.lit(").")).alias("line"))


def as_json(facts: DataFrame, columns: tuple[str, ...] = ("id", "subject", "relation", "value", "valid_from", "valid_to", "confidence")) -> DataFrame:
    return facts.select("id", F.to_json(F.struct(*[c for c in columns if c in facts.columns])).alias("line"))


def as_prompt(hits: DataFrame, title: str = "Known facts") -> str:
    """A text block of a result list for a language model."""
    rows = hits.select(fact_sentence().alias("s"), F.date_format("valid_from", "yyyy-MM-dd").alias("d"), "valid_to").collect()
    return "\n".join([f"{title}:", *[f"- {r['s']} (since {r['d']})" if r["valid_to"] is None else f"- {r['s']} ({r['d']} to {r['valid_to']:%Y-%m-%d})" for r in rows]])
