"""Derived tables follow their published files: same rows as a full rebuild, only touched partitions written, nothing when nothing moved."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import refresh

ROWS = "name string, version int, session date, symbol long, x long"
TABLE = "symbol long, total long, n long, built int, session date"


class Published:
    """Versions of files, as (name, seq) -> rows of (session day, symbol, x)."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.files, self.index, self.reads = spark, folder, {}, {}, []

    def publish(self, name, rows, seq=None):
        seq = seq or self.index.get(name, 0) + 1
        self.files[name, seq], self.index[name] = rows, seq
        made = self.spark.createDataFrame([(name, seq, dt.date(2024, 1, d) if d else None, s, x) for d, s, x in rows], ROWS)
        made.coalesce(1).write.mode("append").partitionBy("name", "version").parquet(f"{self.folder}/landed")

    def drop(self, name):
        del self.index[name]

    def read(self, files):
        self.reads.append(sorted(files))
        return self.spark.read.schema(ROWS).option("basePath", f"{self.folder}/landed").parquet(
            *[f"{self.folder}/landed/name={n}/version={v}" for n, v in files])

    def run(self, derive=None):
        index = self.spark.createDataFrame([(n, s, f"{n}:{s}") for n, s in self.index.items()], "name string, seq long, sha256 string")
        return refresh.refresh(index, self.folder, self.read, derive or (
            lambda rows: rows.groupBy("session", "symbol").agg(F.sum("x").alias("total"), F.count("*").alias("n"))))

    def table(self):
        return sorted((r.session.day, r.symbol, r.total, r.n) for r in refresh.current(self.spark, self.folder, TABLE).collect())

    def rebuilt(self):
        """The same table from nothing."""
        total = {}
        for name, seq in self.index.items():
            for d, s, x in self.files[name, seq]:
                if d:
                    t, n = total.get((d, s), (0, 0))
                    total[d, s] = (t + x, n + 1)
        return sorted((d, s, t, n) for (d, s), (t, n) in total.items())

    def listing(self):
        return {os.path.join(p, f): os.stat(os.path.join(p, f)).st_mtime_ns for top in ("table", "manifest") for p, _, fs in os.walk(f"{self.folder}/{top}")
                for f in fs if f.startswith("part-")}


@pytest.fixture
def site(spark, tmp_path):
    out = Published(spark, str(tmp_path))
    out.publish("a", [(1, 1, 10), (2, 1, 20)])
    out.publish("b", [(2, 1, 5), (3, 2, 7), (None, 9, 9)])
    out.publish("c", [(4, 1, 1)])
    out.publish("empty", [])
    return out


def touched(before, after):
    """Sessions whose partition files differ."""
    day = lambda path: path.split("session=")[1].split("/")[0] if "session=" in path else None
    return {day(p) for p in before.keys() ^ after.keys()} - {None}


def test_first_run_equals_a_full_build(site):
    os.makedirs(f"{site.folder}/landed/name=empty/version=1", exist_ok=True)
    done = site.run()
    assert (done.run, done.files, done.sessions) == (1, 4, 4) and site.table() == site.rebuilt()


def test_only_what_changed_is_read_and_written(site):
    os.makedirs(f"{site.folder}/landed/name=empty/version=1", exist_ok=True)
    site.run()
    before, site.reads = site.listing(), []
    site.publish("b", [(3, 2, 70), (5, 2, 1)])                  # leaves session 2, changes 3, comes to 5
    done = site.run()
    after = site.listing()
    assert (done.run, done.files, done.sessions) == (2, 1, 3) and site.table() == site.rebuilt()
    assert touched(before, after) == {"2024-01-02", "2024-01-03", "2024-01-05"}
    assert site.reads[0] == [("b", 2)] and site.reads[1] == [("a", 1), ("b", 2)]           # c holds none of the touched sessions
    assert all(after[p] == before[p] for p in before.keys() & after.keys())
    assert {r.session.day: r.built for r in refresh.current(site.spark, site.folder, TABLE).collect()} == {1: 1, 2: 2, 3: 2, 4: 1, 5: 2}


def test_nothing_moved_writes_nothing(site):
    os.makedirs(f"{site.folder}/landed/name=empty/version=1", exist_ok=True)
    site.run()
    before, site.reads = site.listing(), []
    assert site.run().run == 0 and site.listing() == before and site.reads == []


def test_removed_files_take_their_sessions_along(site):
    os.makedirs(f"{site.folder}/landed/name=empty/version=1", exist_ok=True)
    site.run()
    site.drop("c")
    site.drop("a")
    done = site.run()
    assert done.files == 2 and site.table() == site.rebuilt() == [(2, 1, 5, 1), (3, 2, 7, 1)]
    site.publish("c", [(4, 1, 3)], seq=9)
    site.run()
    assert site.table() == site.rebuilt()


def test_an_older_seq_is_not_read_again(site):
    os.makedirs(f"{site.folder}/landed/name=empty/version=1", exist_ok=True)
    site.publish("c", [(4, 1, 2)])
    site.run()
    held = site.table()
    site.index["c"] = 1
    assert site.run().run == 0 and site.table() == held


def test_a_refresh_that_broke_off_is_done_again(site):
    os.makedirs(f"{site.folder}/landed/name=empty/version=1", exist_ok=True)
    site.run()
    site.publish("b", [(3, 2, 70)])

    def fails(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        site.run(fails)
    assert site.run().run == 2 and site.table() == site.rebuilt()


def test_nothing_published_yet(spark, tmp_path):
    none = Published(spark, str(tmp_path))
    assert none.run().run == 0 and none.table() == []
