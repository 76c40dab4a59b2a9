"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from lorekeep.catalog import graph, more, plans, recalls, streams, temporal, text, vectors

GROUPS = (temporal, text, vectors, graph, streams, plans, recalls, more)


def registered() -> dict[str, Callable]:
    return {name: fn for g in GROUPS for name, (fn, _) in g.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for g in GROUPS for name, (_, sql) in g.QUERIES.items() if sql}
