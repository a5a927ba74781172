"""Streams that stop, fail and go on: state in RocksDB or the default store, closed by the watermark, equal to the batch."""

import datetime as dt
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tests.conftest import rows
from tests.test_streaming import SCHEMA
from tidemark.streaming import spreads, tape

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(params=["default", "rocksdb"])
def store(spark, request):
    before = spark.conf.get(STORE)
    if request.param == "rocksdb":
        tape.durable_state(spark)
    yield request.param
    spark.conf.set(STORE, before)


class Inbox:
    """A folder files arrive in, one batch each."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n, self.all = spark, f"{folder}/in", 0, []
        os.makedirs(self.folder)

    def add(self, *batches):
        for b in batches:
            tmp = f"{self.folder}-{self.n}"
            self.spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(tmp)
            part = next(f for f in os.listdir(tmp) if f.endswith(".parquet"))
            os.link(f"{tmp}/{part}", f"{self.folder}/b{self.n}.parquet")
            os.utime(f"{self.folder}/b{self.n}.parquet", (1_700_000_000 + self.n * 100,) * 2)
            self.n += 1
            self.all += b

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.folder)

    def batch(self):
        return self.spark.createDataFrame(self.all, SCHEMA)


def day_of(day, names, minute=0):
    """Two prints of each name in one session."""
    at = lambda s, h: dt.datetime(2024, 1, day, h, (minute + s) % 60)
    return [(day * 10_000 + 2 * s + k, s, at(s, 15 + k), 10.0 + s + k, 10 + s, "view") for s in range(names) for k in (0, 1)]


KINDS = {"tape": (tape.live_tape, ["session", "symbol"]), "bars": (lambda t: tape.intraday_bars(t, "1 hour"), ["start", "symbol"])}


def newest(spark, stream, path, keys):
    return tape.latest(tape.landed(spark, path, StructType([*stream.schema, StructField("batch", LongType())])), keys)


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_a_stream_that_stops_goes_on_with_its_state(spark, tmp_path, store, kind):
    make, keys = KINDS[kind]
    inbox = Inbox(spark, str(tmp_path))
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    inbox.add(day_of(9, 50), day_of(10, 50)[::2])
    tape.run(make(inbox.stream()), path, state, "update")
    inbox.add(day_of(10, 50)[1::2], day_of(11, 20))                 # the second half of a session begun before the stop
    done = tape.run(make(inbox.stream()), path, state, "update")
    assert [p["numInputRows"] for p in done if p["numInputRows"]] == [50, 40]         # the two new files alone
    want = make(inbox.batch())
    assert rows(newest(spark, want, path, keys).select(want.columns), *keys) == rows(want, *keys)


def test_state_is_dropped_when_the_watermark_passes(spark, tmp_path, store):
    inbox = Inbox(spark, str(tmp_path))
    inbox.add(*[day_of(d, 100) for d in range(9, 13)], day_of(16, 3), day_of(17, 2))
    done = tape.run(tape.live_tape(inbox.stream()), str(tmp_path / "out"), str(tmp_path / "state"), "update")
    held = tape.state_rows(done)
    assert max(held) <= 200                                          # never more than two sessions of the four
    assert held[-1] <= 5


def test_a_batch_that_fails_is_run_again(spark, tmp_path, store):
    inbox = Inbox(spark, str(tmp_path))
    inbox.add(day_of(9, 30), day_of(10, 30)[::2], day_of(10, 30)[1::2])
    path, state, seen = str(tmp_path / "out"), str(tmp_path / "state"), []

    def land(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        seen.append(batch_id)
        if seen.count(2) == 1 and batch_id == 2:
            raise RuntimeError("lost after the write")

    with pytest.raises(StreamingQueryException):
        tape.run(tape.live_tape(inbox.stream()), path, state, "update", land)
    tape.run(tape.live_tape(inbox.stream()), path, state, "update", land)
    assert seen[:4] == [0, 1, 2, 2]
    want = tape.live_tape(inbox.batch())
    got = newest(spark, want, path, ["session", "symbol"])
    assert rows(got.select(want.columns), "session", "symbol") == rows(want, "session", "symbol")


def test_dedup_remembers_over_a_stop_and_forgets_after_the_watermark(spark, tmp_path, store):
    inbox = Inbox(spark, str(tmp_path))
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    snaps = lambda: tape.snapshot_dedup(inbox.stream().select("symbol", F.col("ts").alias("asof")))
    first = day_of(9, 20)[::2]                                       # all within the watermark's half hour
    inbox.add(first, first)
    tape.run(snaps(), path, state)
    inbox.add(first, day_of(9, 20, 5)[::2])
    tape.run(snaps(), path, state)
    inbox.add(day_of(12, 5), day_of(13, 1))
    done = tape.run(snaps(), path, state)
    got = spark.read.option("basePath", path).parquet(path).groupBy("symbol", "asof").count()
    assert got.filter("count > 1").count() == 0
    assert got.count() == inbox.batch().select("symbol", "ts").distinct().count()
    assert tape.state_rows(done)[-1] <= 12


def test_sketches_survive_a_stop(spark, tmp_path, store):
    inbox = Inbox(spark, str(tmp_path))
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    quotes = lambda t: t.select("symbol", "ts", (F.col("price") - 0.01 * F.col("size")).alias("bid"), (F.col("price") + 0.01 * F.col("size")).alias("ask"))
    shown = lambda df: df.select("day", "symbol", F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("m"), "n")
    inbox.add(day_of(9, 20), day_of(10, 20)[::2])
    tape.run(spreads.spread_sketches(quotes(inbox.stream())), path, state, "update")
    inbox.add(day_of(10, 20)[1::2])
    stream = spreads.spread_sketches(quotes(inbox.stream()))
    tape.run(stream, path, state, "update")
    got = shown(newest(spark, stream, path, ["day", "symbol"]))
    assert rows(got, "day", "symbol") == rows(shown(spreads.spread_sketches(quotes(inbox.batch()))), "day", "symbol")
