"""Catalogue of runnable queries and, where SQL can express them, their check SQL."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxrill.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}

# Named sub-queries for the check SQL: name -> (needs, text).
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, text: str, needs: tuple[str, ...] = ()) -> None:
    """Define a named sub-query usable by check SQL."""
    _VIEWS[name] = (needs, textwrap.dedent(text).strip())


def _with(needs: tuple[str, ...]) -> str:
    ordered: list[str] = []

    def visit(n: str) -> None:
        for dep in _VIEWS[n][0]:
            visit(dep)
        if n not in ordered:
            ordered.append(n)

    for n in needs:
        visit(n)
    return ",\n".join(f"{n} AS (\n{_VIEWS[n][1]}\n)" for n in ordered)


def query(name: str, covers: str, needs: tuple[str, ...] = (), sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``covers`` lists inventory ids."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark, small_methods=True), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        COVERS[name] = covers
        if sql is not None:
            body = textwrap.dedent(sql).strip()
            ctes = _with(needs)
            CHECK_SQL[name] = f"WITH RECURSIVE {ctes}\n{body}" if ctes else body
        return fn

    return wrap
