"""Streams equal the batch on the same rows; a tick beyond the watermark is dropped."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.streaming import tape

SCHEMA = "event_id long, symbol long, ts timestamp, price double, size long, event_type string"


def ticks_at(*specs):
    return [(i, s, dt.datetime(2024, 1, d, h, m), p, 10, "view") for i, (s, d, h, m, p) in enumerate(specs)]


def landed_files(spark, folder, batches):
    """One parquet file per batch, in modification-time order."""
    os.makedirs(folder)
    for i, b in enumerate(batches):
        tmp = f"{folder}-{i}"
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(tmp)
        part = next(f for f in os.listdir(tmp) if f.endswith(".parquet"))
        os.link(f"{tmp}/{part}", f"{folder}/b{i}.parquet")
        os.utime(f"{folder}/b{i}.parquet", (1_700_000_000 + i * 100,) * 2)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture(scope="module")
def batches():
    a = ticks_at((1, 9, 15, 0, 10.0), (1, 9, 15, 30, 12.0), (2, 9, 15, 5, 5.0), (1, 9, 12, 0, 99.0))
    b = ticks_at((1, 9, 15, 10, 9.0), (2, 9, 16, 0, 6.0), (1, 10, 15, 0, 20.0))      # first is out of order, inside the watermark
    c = ticks_at((1, 10, 15, 20, 21.0), (2, 11, 15, 0, 7.0))
    return [a, b, c]


def test_tape_equals_batch(spark, tmp_path, batches):
    stream = tape.live_tape(landed_files(spark, str(tmp_path / "in"), batches))
    path = tape.drain(stream, "t1", "update")
    got = tape.latest(tape.landed(spark, path, stream.schema.add("batch", "long")), ["session", "symbol"])
    want = tape.live_tape(spark.createDataFrame(sum(batches, []), SCHEMA))
    assert rows(got.select(want.columns), "session", "symbol") == rows(want, "session", "symbol")
    assert rows(got.select("open", "last", "high", "low", "n"), "session", "symbol")[0] == (10.0, 12.0, 12.0, 9.0, 3)


def test_bars_equal_batch(spark, tmp_path, batches):
    stream = tape.intraday_bars(landed_files(spark, str(tmp_path / "in"), batches), "1 hour")
    path = tape.drain(stream, "t2", "update")
    got = tape.latest(tape.landed(spark, path, stream.schema.add("batch", "long")), ["start", "symbol"])
    want = tape.intraday_bars(spark.createDataFrame(sum(batches, []), SCHEMA), "1 hour")
    assert rows(got.select(want.columns), "start", "symbol") == rows(want, "start", "symbol")


def test_tick_beyond_the_watermark(spark, tmp_path, batches):
    late = ticks_at((1, 9, 15, 45, 500.0), (2, 12, 15, 0, 8.0))       # its window closed two days before
    stream = tape.live_tape(landed_files(spark, str(tmp_path / "in"), [*batches, ticks_at((2, 12, 15, 0, 7.5)), late]))
    path = tape.drain(stream, "late", "update")
    got = tape.latest(tape.landed(spark, path, stream.schema.add("batch", "long")), ["session", "symbol"])
    assert got.agg(F.max("high")).first()[0] < 500.0
    assert got.filter("session = '2024-01-12' AND symbol = 2").first().n == 2


def drained(spark, stream, name, keys):
    path = tape.drain(stream, name, "update")
    return tape.latest(tape.landed(spark, path, stream.schema.add("batch", "long")), keys)


def test_prints_of_one_instant_go_by_id(spark):
    same = dt.datetime(2024, 1, 9, 15, 0)
    ticks = spark.createDataFrame([(7, 1, same, 3.0, 1, "view"), (5, 1, same, 1.0, 1, "view"), (6, 1, same, 2.0, 1, "view")], SCHEMA)
    assert rows(tape.live_tape(ticks).select("open", "last")) == [(1.0, 3.0)]
    assert rows(tape.intraday_bars(ticks).select("open", "close")) == [(1.0, 3.0)]


def test_late_rows_of_bars_and_spreads(spark, tmp_path, batches):
    """A row whose window the watermark has closed changes nothing; one inside it counts."""
    closed, open_still = ticks_at((1, 9, 15, 5, 500.0)), ticks_at((2, 12, 15, 20, 8.0))
    parts = [*batches, ticks_at((2, 12, 15, 40, 7.5)), [*closed, *open_still]]
    kept = spark.createDataFrame(sum([*parts[:-1], open_still], []), SCHEMA)
    bars = drained(spark, tape.intraday_bars(landed_files(spark, str(tmp_path / "bars"), parts), "1 hour"), "t2-late", ["start", "symbol"])
    want = tape.intraday_bars(kept, "1 hour")
    assert rows(bars.select(want.columns), "start", "symbol") == rows(want, "start", "symbol")
    quoted = lambda ticks: ticks.select("symbol", "ts", F.col("price").alias("bid"), (F.col("price") + 1).alias("ask"))
    spreads = drained(spark, tape.spread_stream(quoted(landed_files(spark, str(tmp_path / "quotes"), parts))), "t5-late", ["day", "symbol"])
    want = tape.spread_stream(quoted(kept))
    assert rows(spreads.select(want.columns), "day", "symbol") == rows(want, "day", "symbol")


def test_wire_items_come_once(spark, tmp_path, batches):
    files = landed_files(spark, str(tmp_path / "in"), [batches[0], batches[0], batches[1], ticks_at((1, 12, 15, 0, 1.0)), batches[0]])
    item = lambda ticks: tape.wire_item(ticks, "headline", F.col("ts"), F.col("event_type"), F.lit(1))
    wire = tape.wire_stream([item(files)])
    got = tape.landed(spark, tape.drain(wire, "t6"), wire.schema.add("batch", "long"))
    want = item(spark.createDataFrame(sum([batches[0], batches[1], ticks_at((1, 12, 15, 0, 1.0))], []), SCHEMA))
    assert rows(got.select(want.columns), "symbol", "time") == rows(want, "symbol", "time")


def test_live_board_counts_over_batches(spark, tmp_path):
    board = spark.createDataFrame([(1, 1), (2, 2), (3, 30), (4, 31)], "symbol long, rank long")
    parts = [ticks_at((1, 9, 15, 0, 10.0), (2, 9, 15, 0, 10.0), (9, 9, 15, 0, 1.0)),
             ticks_at((1, 9, 15, 20, 9.0), (3, 9, 15, 20, 8.0)),               # 1 is down 10%, 3 has its first print
             ticks_at((3, 9, 15, 30, 4.0), (2, 10, 15, 0, 5.0))]               # a new session starts
    path = tape.live_board(landed_files(spark, str(tmp_path / "in"), parts), board)
    by_batch = rows(spark.read.option("basePath", path).parquet(path).select(
        "batch", F.dayofmonth("session"), "top_down5", "top_n", F.round("top_mean_oc", 6), "ext_down5", "ext_n", "ext_mean_oc", "unquoted"), "batch", "session")
    assert by_batch[:4] == [(0, 9, 0, 2, 0.0, 0, 0, None, 2), (1, 9, 1, 2, -0.05, 0, 1, 0.0, 1),
                            (2, 9, 1, 2, -0.05, 1, 1, -0.5, 1), (2, 10, 0, 1, 0.0, 0, 0, None, 3)]
    tail = [x[1:] for x in by_batch[4:]]                                        # a closing batch repeats the newest session
    assert all(x == by_batch[3][1:] for x in tail)


def test_repeated_snapshot_is_ignored(spark, tmp_path, batches):
    files = landed_files(spark, str(tmp_path / "in"), [batches[0], batches[0], batches[1]])
    stream = tape.snapshot_dedup(files.select("symbol", F.col("ts").alias("asof")))
    path = tape.drain(stream, "t3")
    got = tape.landed(spark, path, stream.schema.add("batch", "long"))
    assert got.count() == len(batches[0]) + len(batches[1])


def test_late_runs_go_to_the_side(spark):
    sessions = spark.sql("SELECT DATE '2024-01-09' AS session, TIMESTAMP '2024-01-09 14:30:00' AS open_ts")
    runs = spark.sql("""SELECT * FROM VALUES (1, DATE '2024-01-09', TIMESTAMP '2024-01-09 14:29:59', true), (2, DATE '2024-01-09', TIMESTAMP '2024-01-09 14:30:00', true),
        (3, DATE '2024-01-09', TIMESTAMP '2024-01-09 12:00:00', false), (4, DATE '2024-01-10', TIMESTAMP '2024-01-09 12:00:00', true)
        AS t(id, session, published_at, confirmed)""")
    assert rows(tape.late_exclusion(runs, sessions).select("id", "status"), "id") == [
        (1, "counted"), (2, "late"), (3, "unverified"), (4, "no session")]
