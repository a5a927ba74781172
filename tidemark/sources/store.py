"""Bars clustered by symbol: written once, so that every feature over a symbol's sessions needs no exchange.

The table is bucketed by symbol and sorted by (symbol, session) within a bucket. A window by symbol finds
its rows where they are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import fresh_path

BAR_SCHEMA = ("symbol bigint, session date, open double, high double, low double, close double, volume double, short_volume double, "
              "short_interest double")


def write_bars(bars: DataFrame, buckets: int, path: str | None = None) -> str:
    """Writes `bars` in `buckets` files of one bucket each; returns the table's name in this session's catalog.

    A bucket holds whole symbols, and a symbol's bars are as long as the calendar: size the buckets by the number of symbols.
    """
    path = path or fresh_path(bars.sparkSession, "bars")
    name = f"bars_{uuid.uuid4().hex}"
    dealt = bars.repartition(buckets, "symbol")                # as the buckets are hashed: one task writes one bucket
    dealt.write.bucketBy(buckets, "symbol").sortBy("symbol", "session").option("path", path).format("parquet").saveAsTable(name)
    return name


def attach_bars(spark: SparkSession, path: str, buckets: int, schema: str = BAR_SCHEMA) -> str:
    """Registers bars written earlier under a new name of this session's catalog."""
    name = f"bars_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (symbol) SORTED BY (symbol, session) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name
