"""Query registration and composition of the SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_scans, use_utc
from .ctes import CTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_ctes(sql: str, needs: tuple[str, ...]) -> str:
    """Prefix `sql` with the named common table expressions and all they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for n in CTES[name][0]:
                add(n)
            ordered.append(name)

    for n in needs:
        add(n)
    body = sql.strip()
    if not ordered:
        return body
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1].strip()})" for n in ordered)
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None, needs: tuple[str, ...] | str = ()):
    needs = (needs,) if isinstance(needs, str) else needs

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            bound_scans(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql, needs)
        return fn

    return register


def r(c: str | Column, name: str | None = None, places: int = 6) -> Column:
    """Rounded output column (no negative zero), named after its input."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, places) + F.lit(0.0)).alias(name or c)
