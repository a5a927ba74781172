"""Spreads over recent sessions: streams with late files equal the batch, small sketches stay within their rank error."""

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tests.test_streaming import landed_files
from tidemark.streaming import spreads, tape


def quotes_of(stream):
    return stream.select("symbol", "ts", (F.col("price") - 0.005 * F.col("size")).alias("bid"), (F.col("price") + 0.005 * F.col("size")).alias("ask"))


def tick(day, symbol, spread, minute=0, hour=15):
    return (0, symbol, dt.datetime(2024, 1, 1, hour, minute) + dt.timedelta(days=day), 100.0, spread, "view")


def brute(rows, sessions):
    """Lower median per symbol and day over the sessions of the calendar that end on the day."""
    by = defaultdict(list)
    for _, s, ts, price, size, _ in rows:
        by[ts.date(), s].append(0.01 * size / price)
    days = sorted({d for d, _ in by})
    out = {}
    for d, s in by:
        span = days[max(0, days.index(d) - sessions + 1):days.index(d) + 1]
        held = [sorted(by[x, s]) for x in span if (x, s) in by]
        v = sorted(sum(held, []))
        out[d, s] = (round(v[(len(v) - 1) // 2], 12), len(v), len(held))
    return out


def run(spark, folder, batches, sessions, k=spreads.K):
    path = spreads.recent_spread_stream(quotes_of(landed_files(spark, folder, batches)), sessions, k)
    got = tape.latest(tape.landed(spark, path, spreads.RECENT + ", batch bigint"), ["day", "symbol"])
    return {(r.day, r.symbol): (round(r.spread, 12), r.n, r.sessions) for r in got.collect()}


def test_late_files_reach_every_span_they_lie_in(spark, tmp_path):
    rng = random.Random(1)
    first = [tick(d, s, rng.randint(1, 99), rng.randint(0, 59)) for d in range(0, 6) for s in (1, 2) if (d, s) != (3, 2) for _ in range(3)]
    second = [tick(d, s, rng.randint(1, 99), rng.randint(0, 59), 23) for d in range(5, 9) for s in (1, 3) for _ in range(2)]
    late = [tick(8, 1, 7, 45, 23), tick(8, 2, 90, 50, 23), tick(9, 1, 5, 0, 0)]        # an open day again, and a name new to it
    batches = [first, second, late]
    assert run(spark, str(tmp_path / "in"), batches, 4) == brute(sum(batches, []), 4)


def test_a_day_that_comes_late_shifts_the_calendar(spark, tmp_path):
    """The day between is inside the watermark of the first file only by its hour; spans of later days lose their oldest session."""
    at = lambda day, hour, minute, spread: (0, 1, dt.datetime(2024, 1, day, hour, minute), 100.0, spread, "view")
    batches = [[at(1, 12, 0, 10), at(3, 0, 5, 30)], [at(2, 23, 50, 20), at(3, 0, 10, 40)]]
    assert run(spark, str(tmp_path / "in"), batches, 2) == brute(sum(batches, []), 2)


def test_beyond_the_watermark_nothing_changes(spark, tmp_path):
    batches = [[tick(0, 1, 10), tick(4, 1, 30)], [tick(5, 1, 50)], [tick(0, 1, 99)]]
    assert run(spark, str(tmp_path / "in"), batches, 3) == brute(sum(batches[:2], []), 3)


def test_rank_error_of_small_sketches(spark):
    rng = random.Random(2)
    rows = [tick(d, 1, rng.randint(1, 10**6), d) for d in range(10) for _ in range(4000)]
    ticks = spark.createDataFrame(rows, "event_id long, symbol long, ts timestamp, price double, size long, event_type string")
    k = 64
    sketched = spreads.spread_sketches(quotes_of(ticks), k)
    calendar = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i), i) for i in range(10)], "day date, i int")
    got = spreads.recent_spread(sketched, calendar, 10).filter("sessions = 10").first()
    values = sorted(0.01 * r[4] / 100 for r in rows)
    place = sum(v <= got.spread for v in values) / len(values)
    assert got.n == len(values) and abs(place - 0.5) <= 3 * spreads.rank_error(k)
    largest = sketched.agg(F.max(F.length("sketch"))).first()[0]
    assert largest < 4000 * 8 / 4                                    # far less than the day's quotes


def test_days_without_a_spread_and_empty_input(spark):
    schema = "symbol long, ts timestamp, bid double, ask double"
    rows = [(1, dt.datetime(2024, 1, 1), 0.0, 0.0), (1, dt.datetime(2024, 1, 1), None, 2.0), (2, dt.datetime(2024, 1, 1), 1.0, 1.0)]
    got = spreads.spread_sketches(spark.createDataFrame(rows, schema)).select("symbol", "n").collect()
    assert [tuple(r) for r in got] == [(2, 1)]
    assert spreads.spread_sketches(spark.createDataFrame([], schema)).count() == 0
