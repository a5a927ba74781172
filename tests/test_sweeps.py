"""Bands by sweep, tails of long records, distinct counts from sketches, edges from counted scores: against brute force."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of, rows
from tidemark.operators import joins, models, records

BANDS = "lo long, hi long, id long"


def some_bands(n, gap=5):
    rng, at, out = random.Random(n), 0, []
    for i in range(n):
        lo = at + rng.randint(0, gap)
        hi = lo + rng.randint(0, 9)
        out.append((lo, hi, i))
        at = hi + 1
    return out


def test_long_reports_give_the_rows_of_short_ones(spark):
    bands = some_bands(300)
    rng = random.Random(1)
    values = [(i, rng.randint(-20, bands[-1][1] + 50)) for i in range(2000)] + [(9000 + i, 77) for i in range(500)] + [(9999, None)]
    df, report = spark.createDataFrame(values, "i long, v long"), spark.createDataFrame(bands, BANDS)
    swept, met = joins.band_join(df, report, "v", broadcast_rows=10), joins.band_join(df, report, "v")
    assert swept.columns == met.columns == ["i", "v", "lo", "hi", "id"]
    assert rows(swept, "i") == rows(met, "i")
    held = {r.i: r.id for r in swept.collect()}
    for i, v in values:
        want = next((b for lo, hi, b in bands if v is not None and lo <= v <= hi), 299)
        assert held[i] == want


def test_a_report_of_many_bands_is_not_broadcast(spark):
    bands = spark.range(1_000_000).select((F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 6).alias("hi"), (F.col("id") * 3).alias("id"))
    values = spark.range(200_000).select("id", (F.col("id") * 47).alias("v"))
    out = joins.band_join(values.withColumnRenamed("id", "i"), bands, "v")
    plan = plan_of(out)
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    wrong = out.filter(F.when(F.col("v") % 10 <= 6, F.col("id") != F.floor(F.col("v") / 10) * 3).otherwise(F.col("id") != 2_999_997))
    assert out.count() == 200_000 and wrong.count() == 0


@pytest.mark.parametrize("by", [[], ["g"]])
def test_containment_against_all_pairs(spark, by):
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None]), lo, lo + rng.randint(0, 12), i) for i in range(200) for lo in [rng.randint(0, 60)]] + [("a", None, 3, 900), ("a", 3, None, 901)]
    got = {r.i for r in joins.disjoint_bands(spark.createDataFrame(data, "g string, lo long, hi long, i long"), by).collect()}

    def holds(a, b):
        if None in (a[1], a[2], b[1], b[2]) or by and (a[0] is None or a[0] != b[0]):
            return False
        return b[1] >= a[1] and b[2] <= a[2] and (b[1], b[2]) != (a[1], a[2])

    assert got == {a[3] for a in data if not any(holds(a, b) for b in data)}


def test_containment_of_many_bands_broadcasts_nothing(spark):
    report = spark.range(300_000).select((F.col("id") * 2).alias("lo"), (F.col("id") * 2 + F.when(F.col("id") % 3 == 0, 4).otherwise(1)).alias("hi"))
    out = joins.disjoint_bands(report)
    assert "BroadcastNestedLoopJoin" not in plan_of(out)
    assert out.count() == 200_000                            # every third one holds its neighbour


def exact_tail(k, n, p):
    p = Fraction(p)
    return float(sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_tail_against_exact_sums(spark):
    cases = [(k, n, p) for n in (1, 5, 40, 200, 700) for k in {0, 1, n // 4, n // 3, n // 2, n - 1, n, min(n, 64), min(n, 65), max(0, n - 66)} for p in (0.03, 0.25, 0.5, 0.9)]
    df = spark.createDataFrame([(*c, exact_tail(*c)) for c in cases], "k long, n long, p double, want double")
    got = df.withColumn("t", records.binomial_tail(F.col("k"), F.col("n"), F.col("p"))).collect()
    assert max(abs(r.t - r.want) for r in got) < 1e-12


def test_tail_of_very_long_records(spark):
    cases = [(10_000_000, 40_000_000, 0.25), (10_004_000, 40_000_000, 0.25), (9_990_000, 40_000_000, 0.25), (10_000_000, 10_000_100, 0.99999), (5, 10_000_000, 1e-6), (0, 10_000_000, 0.5)]
    df = spark.createDataFrame(cases, "k long, n long, p double")
    tail = records.binomial_tail(F.col("k"), F.col("n"), F.col("p"))
    mirror = records.binomial_tail(F.col("n") - F.col("k") - 1, F.col("n"), 1 - F.col("p"))
    got = df.select("k", "n", "p", tail.alias("t"), mirror.alias("m")).collect()
    assert all(abs(r.t + r.m - 1) < 1e-9 for r in got)

    def normal(k, n, p):                                     # with the skewness term of the Edgeworth series
        s = math.sqrt(n * p * (1 - p))
        z = (k + 0.5 - n * p) / s
        return 0.5 * math.erfc(-z / math.sqrt(2)) - (1 - 2 * p) / (6 * s) * (z * z - 1) * math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    assert all(abs(r.t - normal(r.k, r.n, r.p)) < 1e-7 for r in got[:3])
    assert got[4].t == pytest.approx(sum(math.exp(-10) * 10 ** i / math.factorial(i) for i in range(6)), abs=1e-5)
    assert got[5].t == 0.0


def test_tail_at_the_ends(spark):
    df = spark.createDataFrame([(0, 10, 0.0), (3, 10, 0.0), (10, 10, 1.0), (9, 10, 1.0), (None, 10, 0.5)], "k long, n long, p double")
    got = [r[0] for r in df.select(records.binomial_tail(F.col("k"), F.col("n"), F.col("p"))).collect()]
    assert got == [1.0, 1.0, 1.0, 0.0, None]


def test_distinct_counts_of_spans(spark):
    n_days, n = 40, 60_000
    data = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(20_000))).alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % n_days).cast("int")).alias("session"))
    stored = records.distinct_sketches(data)
    assert stored.agg(F.max(F.length("keys"))).first()[0] < 2 ** records.HLL_BITS + 100
    spans = spark.createDataFrame([("all", "2024-01-01", "2024-12-31"), ("ten", "2024-01-05", "2024-01-14"), ("one", "2024-01-07", "2024-01-07"), ("none", "2023-01-01", "2023-02-01")],
                                  "id string, start string, end string").select("id", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    got = {r.id: r for r in records.distinct_in_spans(stored, spans).collect()}
    assert set(got) == {"all", "ten", "one"}
    for i in got:
        s, e = next((r.start, r.end) for r in spans.collect() if r.id == i)
        exact = data.filter(F.col("session").between(s, e)).agg(F.countDistinct("symbol"), F.countDistinct("session"), F.count("*")).first()
        assert abs(got[i].n_symbols - exact[0]) <= 4 * records.distinct_error() * exact[0]
        assert (got[i].n_days, got[i].n_rows) == (exact[1], exact[2])


def tied_scores(spark):
    """Most rows share a few scores, so that edges fall inside ties."""
    rng = random.Random(6)
    data = [(m, d, s, rng.choice([0.5, 0.5, 0.5, 0.25, round(rng.random(), 3)]), None if rng.random() < 0.05 else rng.gauss(0, 0.06)) for m in ("m0", "m1", None) for d in range(12) for s in range(40)]
    df = spark.createDataFrame(data, "model string, d int, symbol long, score double, next_oc double")
    return df.select("model", F.date_add(F.lit("2024-01-01").cast("date"), "d").alias("session"), "symbol", "score", "next_oc")


def rounded(df, *order):
    return [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows(df, *order)]


def test_deciles_from_counted_scores(spark):
    scores = tied_scores(spark)
    for bins in (10, 3, 700):
        a, b = (records.calibration(scores, bins, small).select("model", "bin", "pred", "actual", "n") for small in (False, True))
        assert rounded(a, "model", "bin") == rounded(b, "model", "bin")


def test_caps_from_counted_scores(spark):
    scores = tied_scores(spark).filter("model is not null")
    for share in (0.01, 0.3, 1.0):
        a, b = (models.probability_caps(scores, share, small).select("model", "cap", "n_calls") for small in (False, True))
        assert rounded(a, "model") == rounded(b, "model")
