"""A SELECT subset of SPARQL compiled to joins over a triple table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""\s*(?:(?P<var>\?[A-Za-z_]\w*)|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<iri><[^>\s]*>)|(?P<op>!=|<=|>=|&&|\|\||[{}().,;=<>!*])|(?P<word>[^\s{}().,;=<>!*"'?]+(?:\.[^\s{}().,;=<>!*"'?]+)*))"""
)


@dataclass
class Filter:
    kind: str  # "regex", "=", "!=", "<", ">", "<=", ">="
    var: str
    value: str
    flags: str = ""


@dataclass
class Block:
    patterns: list[tuple[str, str, str]] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)


@dataclass
class Query:
    variables: list[str] | None  # None: *
    distinct: bool
    where: Block
    optional: list[Block]
    order: list[tuple[str, bool]]
    limit: int | None
    offset: int


class SparqlError(ValueError):
    """The text is not in the supported subset."""


class _Reader:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise SparqlError(f"cannot read {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def take(self, *expected: str) -> str:
        t = self.peek()
        if not t or expected and t.upper() not in expected:
            raise SparqlError(f"expected {' or '.join(expected) or 'more'}, found {t!r}")
        self.at += 1
        return t

    def accept(self, word: str) -> bool:
        if self.peek().upper() == word:
            self.at += 1
            return True
        return False


def _literal(token: str) -> str:
    if token[:1] in "\"'" and len(token) > 1:
        return re.sub(r"\\(.)", r"\1", token[1:-1])
    return token[1:-1] if token.startswith("<") else token


def _filter(r: _Reader) -> Filter:
    wrapped = r.accept("(")
    if r.peek().lower() == "regex":
        r.take()
        r.take("(")
        var = r.take()
        r.take(",")
        value, flags = _literal(r.take()), ""
        if r.accept(","):
            flags = _literal(r.take())
        r.take(")")
        out = Filter("regex", var, value, flags)
    else:
        if r.kind() != "var":
            raise SparqlError(f"unknown filter at {r.peek()!r}")
        var = r.take()
        out = Filter(r.take("=", "!=", "<", ">", "<=", ">="), var, _literal(r.take()))
    if wrapped:
        r.take(")")
    return out


def _block(r: _Reader, optional: list[Block] | None) -> Block:
    out = Block()
    r.take("{")
    while not r.accept("}"):
        if r.accept("FILTER"):
            out.filters.append(_filter(r))
        elif r.peek().upper() == "OPTIONAL":
            if optional is None:
                raise SparqlError("OPTIONAL inside OPTIONAL is not supported")
            r.take()
            optional.append(_block(r, None))
        elif r.peek().upper() in ("UNION", "GRAPH", "MINUS", "BIND", "VALUES", "SERVICE") or r.peek() == "{":
            raise SparqlError(f"{r.peek()} is not supported")
        else:
            s = r.take()
            while True:
                out.patterns.append((s, r.take(), r.take()))
                if not r.accept(";"):
                    break
        r.accept(".")
    return out


def parse(text: str) -> Query:
    r = _Reader(text)
    r.take("SELECT")
    distinct = r.accept("DISTINCT")
    variables: list[str] | None = []
    if r.accept("*"):
        variables = None
    else:
        while r.kind() == "var":
            variables.append(r.take())
        if not variables:
            raise SparqlError("no variables are selected")
    r.accept("WHERE")
    optional: list[Block] = []
    where = _block(r, optional)
    order, limit, offset = [], None, 0
    while r.peek():
        if r.accept("ORDER"):
            r.take("BY")
            while r.kind() == "var" or r.peek().upper() in ("ASC", "DESC"):
                if r.kind() == "var":
                    order.append((r.take(), True))
                else:
                    up = r.take().upper() == "ASC"
                    r.take("(")
                    order.append((r.take(), up))
                    r.take(")")
        elif r.accept("LIMIT"):
            limit = int(r.take())
        elif r.accept("OFFSET"):
            offset = int(r.take())
        else:
            raise SparqlError(f"unexpected {r.peek()!r}")
    return Query(variables, distinct, where, optional, order, limit, offset)


def _pattern(triples: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    """Rows that fit a pattern, one column per variable; a literal is a filter, a repeated variable an equality."""
    tests, columns = [], {}
    for position, term in zip(("s", "p", "o"), pattern):
        if term.startswith("?"):
            if term[1:] in columns:
                tests.append(F.col(columns[term[1:]]) == F.col(position))
            else:
                columns[term[1:]] = position
        else:
            tests.append(F.col(position) == _literal(term))
    rows = triples.where(reduce(lambda a, b: a & b, tests)) if tests else triples
    return rows.select(*[F.col(c).alias(v) for v, c in columns.items()]) if columns else rows.select(F.lit(1).alias("__any")).limit(1)


def _connected(patterns: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Patterns ordered so that each shares a variable with one before it where that is possible."""
    rest, out, seen = list(patterns), [], set()
    while rest:
        best = max(rest, key=lambda p: (bool(seen & {t for t in p if t.startswith("?")}) or not seen, sum(not t.startswith("?") for t in p), -rest.index(p)))
        rest.remove(best)
        out.append(best)
        seen |= {t for t in best if t.startswith("?")}
    return out


def _match(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    found = None
    for p in _connected(patterns):
        rows = _pattern(triples, p)
        if found is None:
            found = rows
        else:
            shared = [c for c in rows.columns if c in found.columns]
            found = found.join(rows, shared) if shared else found.join(rows, how="cross")  # the query asks for a product
    if found is None:
        raise SparqlError("an empty pattern")
    return found


def _test(f: Filter, columns: list[str]) -> Column:
    name = f.var[1:]
    if name not in columns:
        return F.lit(False)
    c = F.col(f"`{name}`")
    if f.kind == "regex":
        return F.coalesce(c.rlike(("(?i)" if "i" in f.flags else "") + f.value), F.lit(False))
    tests = {"=": c == f.value, "!=": c != f.value}
    if f.kind in tests:
        return F.coalesce(tests[f.kind], F.lit(False))
    number, limit = F.expr(f"try_cast(`{name}` AS DOUBLE)"), float(f.value)
    return F.coalesce({"<": number < limit, ">": number > limit, "<=": number <= limit, ">=": number >= limit}[f.kind], F.lit(False))


def execute(text: str | Query, triples: DataFrame) -> DataFrame:
    """Run a query over `triples` (s, p, o).  Unbound variables come out as empty strings.

    A filter holds for the block it stands in.  DISTINCT applies before ORDER BY; an order by a variable that isn't
    selected needs the query not to be DISTINCT.
    """
    q = parse(text) if isinstance(text, str) else text
    found = _match(triples, q.where.patterns)
    for f in q.where.filters:
        found = found.where(_test(f, found.columns))
    for block in q.optional:
        part = _match(triples, block.patterns)
        for f in block.filters:
            part = part.where(_test(f, part.columns))
        shared = [c for c in part.columns if c in found.columns]
        found = found.join(part, shared, "left") if shared else found
    names = [v[1:] for v in q.variables] if q.variables is not None else [c for c in found.columns if c != "__any"]
    bound = {n: F.coalesce(F.col(f"`{n}`"), F.lit("")) if n in found.columns else F.lit("") for n in names}
    keys = [(F.coalesce(F.col(f"`{v[1:]}`"), F.lit("")) if v[1:] in found.columns else F.lit(""), up, v[1:]) for v, up in q.order]
    if q.distinct:
        out = found.select(*[c.alias(n) for n, c in bound.items()]).distinct()
        ordering = [(F.col(n).asc() if up else F.col(n).desc()) for _, up, n in keys if n in names]
        out = out.orderBy(*ordering, *names) if ordering else out
    else:
        ordering = [(c.asc() if up else c.desc()) for c, up, _ in keys]
        out = (found.orderBy(*ordering, *[c for n, c in bound.items()]) if ordering else found).select(*[c.alias(n) for n, c in bound.items()])
    if q.offset:
        out = out.offset(q.offset)
    return out if q.limit is None else out.limit(q.limit)


def with_sources(solutions: DataFrame, pattern: tuple[str, str, str], facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Solutions with `_source` and `source_text`: the chunk from which the fact bound by a pattern comes (the first by id), empty
    without one.  `facts` has s, p, o and source_id; the pattern's variables must be among the solutions' columns."""
    tests, keys = [], []
    for position, term in zip(("s", "p", "o"), pattern):
        if term.startswith("?"):
            keys.append((position, term[1:]))
        else:
            tests.append(F.col(position) == _literal(term))
    rows = facts.where("source_id is not null")
    for t in tests:
        rows = rows.where(t)
    first = rows.groupBy(*[F.col(p).alias(f"k_{p}") for p, _ in keys]).agg(F.min("source_id").alias("_source"))
    texts = first.join(chunks.select(F.col("id").cast("string").alias("c_id"), F.col("text").alias("source_text")), F.col("_source").cast("string") == F.col("c_id"), "left")
    on = [F.col(f"`{v}`") == F.col(f"k_{p}") for p, v in keys]
    joined = solutions.join(texts, reduce(lambda a, b: a & b, on), "left")
    return joined.select(*[F.col(f"`{c}`") for c in solutions.columns], F.coalesce(F.col("_source").cast("string"), F.lit("")).alias("_source"), F.coalesce("source_text", F.lit("")).alias("source_text"))


def edge_triples(edges: DataFrame) -> DataFrame:
    """Typed edges as triples with predicates edge:KIND."""
    return edges.select(F.col("src").cast("string").alias("s"), F.concat(F.lit("edge:"), F.col("kind")).alias("p"), F.col("dst").cast("string").alias("o"))
