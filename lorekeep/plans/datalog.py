"""Datalog rules compiled to equi-joins, applied until nothing new follows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.scratch import materialise

_ATOM = re.compile(r"\s*([A-Za-z_]\w*)\s*\(([^()]*)\)\s*")


@dataclass(frozen=True)
class Atom:
    name: str
    args: tuple[str, ...]


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]


DEFAULT_RULES = (
    "manages(X, Y) :- reports_to(Y, X).",
    "colleague_of(X, Y) :- works_at(X, Z), works_at(Y, Z).",
    "lives_in(X, Y) :- moved_to(X, Y).",
    "parent_of(X, Y) :- child_of(Y, X).",
)


def parse_rule(text: str) -> Rule:
    """head(X, Y) :- b1(X, Z), b2(Z, Y).   Capitalised arguments are variables, _ is anything, others are constants."""
    head, sep, body = text.strip().rstrip(".").partition(":-")
    if not sep:
        raise ValueError("a rule needs :-")

    def atoms(part: str) -> list[Atom]:
        found, at = [], 0
        while at < len(part):
            m = _ATOM.match(part, at)
            if not m:
                raise ValueError(f"not an atom: {part[at:]!r}")
            args = tuple(a.strip().strip("'\"") for a in m[2].split(","))
            if not 1 <= len(args) <= 3:
                raise ValueError("atoms have one to three arguments")
            found.append(Atom(m[1], args))
            at = m.end()
            if part[at : at + 1] == ",":
                at += 1
        return found

    (h,) = atoms(head)
    rule = Rule(h, tuple(atoms(body)))
    free = {a for a in h.args if is_variable(a)} - {a for b in rule.body for a in b.args}
    if free:
        raise ValueError(f"head variables without a body: {', '.join(sorted(free))}")
    return rule


def is_variable(term: str) -> bool:
    return term[:1].isupper()


def _atom_rows(facts: DataFrame, atom: Atom) -> DataFrame:
    """Bindings of one atom, with the scope column; one argument binds the subject, two subject and value."""
    rows = facts.where(F.col("relation") == atom.name)
    columns = {}
    for position, term in zip(("subject", "value", "user_id"), atom.args):
        if term == "_":
            continue
        if is_variable(term):
            if term in columns:
                rows = rows.where(F.col(columns[term]) == F.col(position))
            columns[term] = position
        else:
            rows = rows.where(F.col(position) == term)
    return rows.select(F.col("user_id").alias("__scope"), *[F.col(c).alias(v) for v, c in columns.items()])


def _consequences(facts: DataFrame, rule: Rule) -> DataFrame:
    """All heads that follow from the facts; atoms that share a variable are joined first, adaptive execution picks the join."""
    rest, bound = list(rule.body), None
    while rest:
        pick = next((a for a in rest if bound is not None and set(a.args) & set(bound.columns)), rest[0])
        rest.remove(pick)
        rows = _atom_rows(facts, pick)
        bound = rows if bound is None else bound.join(rows, ["__scope", *[c for c in rows.columns if c in bound.columns and c != "__scope"]])
    args = [F.col(a) if is_variable(a) else F.lit(a) for a in rule.head.args]
    value = args[1] if len(args) > 1 else F.lit("true")
    return bound.select(F.col("__scope").alias("user_id"), args[0].alias("subject"), F.lit(rule.head.name).alias("relation"), value.alias("value")).where(
        "subject <> value"
    )


def apply_rules(facts: DataFrame, rules: list[str] | tuple[str, ...] = DEFAULT_RULES, rounds: int = 3, confidence: float = 0.75) -> DataFrame:
    """Facts that follow, within each user's scope: user_id, subject, relation, value, confidence, round.

    `facts` needs user_id, subject, relation, value.  What is among the facts already, active or retired, isn't derived
    again.  Each round joins what is known by then and keeps what is new; it ends early when nothing is.
    """
    parsed = [parse_rule(r) for r in rules]
    keys = ["user_id", "subject", "relation", "value"]
    known = facts.select(*keys).distinct()
    derived = None
    for n in range(1, rounds + 1):
        new = None
        for rule in parsed:
            part = _consequences(known, rule)
            new = part if new is None else new.unionByName(part)
        new = materialise(new.distinct().join(known, keys, "left_anti"), f"rules-{n}")
        if new.isEmpty():
            break
        known = known.unionByName(new)
        part = new.withColumn("confidence", F.lit(confidence)).withColumn("round", F.lit(n))
        derived = part if derived is None else derived.unionByName(part)
    if derived is None:
        return facts.select(*keys).limit(0).withColumn("confidence", F.lit(confidence)).withColumn("round", F.lit(0))
    return derived
