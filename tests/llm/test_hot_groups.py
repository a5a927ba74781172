"""Shared notices, rows without an id and equal rows in the corpus operators; spark comes from tests/conftest.py."""

import random

import duckdb
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_components, prose
from tidemark.llm import jaccard, lines, mixing, sharding
from tidemark.llm.common import numbered
from tools.compare import compare

TEXTS = "doc_id long, text string"


# ── Jaccard join ────────────────────────────────────────────────────────────


def test_a_notice_in_many_unlinked_texts(spark):
    rng = random.Random(21)
    notice = "the notice of this file is kept below"
    rows = [(i, f"{notice} x{i}") for i in range(150)]                                        # share all but one shingle, link with none
    rows += [(200 + i, f"{notice} and its owner keeps it in a safe place for as long as it is asked for y{i % 4} z{i}") for i in range(60)]
    rows += [(300 + i, f"{prose(rng.randint(3, 60), rng)} {notice} {prose(rng.randint(3, 60), rng)}") for i in range(60)]
    base = prose(50, rng)
    rows += [(400, f"{base} {notice}"), (401, f"{base} {notice} tail"), (402, f"{notice} {base}")]
    got = {tuple(r) for r in jaccard.join(spark.createDataFrame(rows, TEXTS)).collect()}
    assert got == brute_components(rows)


def test_blocks_that_cannot_meet_are_not_multiplied(spark):
    """The notice of five shingles at the second place: no two of its documents are paired, however many there are."""
    cells = spark.range(5000).select(F.lit(7).cast("long").alias("g"), F.col("id"), F.lit(0).cast("long").alias("tag"), F.lit(5).alias("n"), F.lit(1).alias("place"),
                                     F.col("id").alias("component"))
    assert jaccard._blocks(cells).count() == 0 and jaccard._product(cells).count() == 0
    first = cells.withColumn("place", F.when(F.col("id") < 2, 0).otherwise(1))
    assert jaccard._product(first).select("x.id", F.col("y.id").alias("other")).count() == 1
    assert jaccard._blocks(cells.withColumn("place", F.lit(0)).withColumn("component", F.lit(3).cast("long"))).count() == 0


def test_rows_without_an_id_link_nothing(spark):
    """They are documents without a component: no bridge between two others."""
    rng = random.Random(22)
    a = prose(100, rng).split()
    step = lambda k: " ".join([*a[:100 - k], *[f"w{j}" for j in range(k)]])
    rows = [(1, step(0)), (None, step(7)), (2, step(14)), (None, step(0)), (3, step(30))]
    out = [tuple(r) for r in jaccard.join(spark.createDataFrame(rows, TEXTS)).collect()]
    known = [r for r in rows if r[0] is not None]
    assert {r for r in out if r[0] is not None} == brute_components(known)
    assert sorted(r[2] for r in out if r[0] is not None) == [1, 2, 3]
    assert [r[2] for r in out if r[0] is None] == [None, None]


# ── lines ───────────────────────────────────────────────────────────────────


def test_lines_of_rows_without_an_id(spark):
    """Each text without an id is a document; twin and operator agree, and state is reversible."""
    hot = "a line that very many texts without an id hold"
    rows = [(None, f"{hot}\n{w}") for w in ("one", "two", "three", "three")] + [(5, f"{hot}\nfive"), (None, None), (None, ""), (6, "five"), (-3, f"{hot}\nminus")]
    docs = spark.createDataFrame(rows, TEXTS)
    got = lines.dedup(docs)
    out = got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    assert compare(out.toPandas().astype({"doc_id": "Int64"}), con.sql(lines.SQL).df().astype({"doc_id": "Int64"})) == "ok"
    kept = [r.doc_id for r in got.collect() if r.text.startswith("a line")]
    assert kept == [5]                                              # the largest id, above all texts without one
    anonymous = spark.createDataFrame([r for r in rows if r[0] is None], TEXTS)
    lowest = [r for r in lines.dedup(anonymous).collect() if r.text.startswith("a line")]
    assert len({r.text for r in lowest}) == 1                        # one text keeps the line, in each of its rows
    state = lines.insert(lines.empty(spark, 2), docs)
    back = lines.remove(lines.insert(state, spark.createDataFrame([(None, f"{hot}\nfour")], TEXTS)), spark.createDataFrame([(None, f"{hot}\nfour")], TEXTS))
    table = lambda s: sorted(map(repr, s.shards.filter("kind = 0").select("shard", "a", "b", "refs", "top").collect()))
    assert table(back) == table(state)


# ── equal rows ──────────────────────────────────────────────────────────────


def equal_rows(spark, n=900):
    """A third equal, a third without an id, all with further columns."""
    rows = [(7, "the same text", "en", "s", 1)] * (n // 3) + [(None, f"text {i} " + "w " * (i % 5), "en", "s", 1) for i in range(n // 3)] + [
        (1000 + i, f"other {i} a b", None, ["s", "t", None][i % 3], i) for i in range(n // 3)] + [(7, "the same text", "en", "s", 2)] * 5
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_numbers_of_equal_rows(spark):
    rows = equal_rows(spark).withColumn("tags", F.create_map(F.lit("a"), F.col("n_chars") % 2))
    got = numbered(rows, "no", 64)
    assert got.columns == [*rows.columns, "no"] and got.count() == rows.count()
    same = [r.no for r in got.filter("doc_id = 7 and n_chars = 1").collect()]
    assert sorted(same) == list(range(300))
    assert got.filter("doc_id >= 1000 and no > 0").count() == 0
    assert sorted(map(repr, got.drop("no").collect())) == sorted(map(repr, rows.collect()))


def test_equal_rows_share_no_bucket(spark):
    rows = equal_rows(spark)
    placed = sharding._apart(rows.withColumn("__place", F.xxhash64("doc_id", F.col("text"))))
    assert placed.count() == rows.count() and placed.select("__place").distinct().count() == rows.count()
    one = sharding.shard(rows, 4, bucket_bytes=2000).toPandas()
    two = sharding.shard(rows.repartition(9).withColumn("m", F.create_map(F.lit("k"), F.lit(1))), 4, bucket_bytes=2000).drop("m").toPandas()
    at = lambda p: sorted(map(repr, p.astype(object).where(p.notna(), None).itertuples(index=False, name=None)))
    assert at(one) == at(two)
    same = one[one.text == "the same text"]
    assert same.groupby("shard").size().min() > 40                 # spread over the shards
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in one.groupby("shard"))


def test_equal_rows_spread_over_the_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 30)
    rows = equal_rows(spark)
    planned = mixing.plan(rows)
    con = duckdb.connect()
    con.register("documents", rows.toPandas().astype({"doc_id": "Int64"}))
    got, want = planned.select("doc_id", "size", "source_size", "target", "taken").toPandas(), con.sql(mixing.SQL).df()
    assert compare(got.astype({"doc_id": "Int64"}), want.astype({"doc_id": "Int64"})) == "ok"
    assert planned.select("__order").distinct().count() >= 900
    slices = planned.filter("doc_id = 7 or doc_id is null").select(F.substring("__order", 1, 1).alias("c")).groupBy("c").count().collect()
    assert len(slices) == 16 and max(r["count"] for r in slices) < 3 * 605 / 16
    mixed = mixing.mix(rows)
    assert mixed.columns == rows.columns
    total = planned.select(F.sum(F.col("taken") / F.greatest("size", F.lit(1)))).first()[0]
    assert mixed.count() == round(total)


def xx(*values):
    """Spark's 64-bit hash of a row of (bytes) values: one after another, each seeded with the hash before; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v, seed=h)
    return h


def test_shards_recomputed(spark):
    """Buckets, permutations and cuts by hand, from the same hashes and generator."""
    rng = random.Random(23)
    rows = [(i, prose(rng.randint(0, 40), rng)) for i in range(300)] + [(None, "no id"), (None, None), (2**40, "äöü ñ")]
    seed, shards, size = 7, 5, 4000
    whole = lambda x, n: None if x is None else int(x).to_bytes(n, "little", signed=True)
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    n = -(-sum(len((t or "").encode()) + 1 for _, t in rows) // size)
    buckets = {}
    for i, t in rows:
        place = signed(xx(whole(seed, 4), whole(i, 8), whole(signed(xx(b"text", (t or "").encode())), 8)))
        buckets.setdefault(signed(xx(whole(seed + 1, 4), whole(place, 8))) % n, []).append((place, i, t))
    want, start = set(), 0
    for b in sorted(buckets):
        held = sorted(buckets[b], key=lambda r: r[0])
        at = np.random.Generator(np.random.PCG64([seed, b])).permutation(len(held))
        for (_, i, t), k in zip(held, at, strict=True):
            position = start + int(k)
            s = position * shards // len(rows)
            want.add((i, t, s, position - -(-s * len(rows) // shards)))
        start += len(held)
    got = {tuple(r) for r in sharding.shard(spark.createDataFrame(rows, TEXTS), shards, seed, size).collect()}
    assert got == want
