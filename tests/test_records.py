import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import records as R

day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)


def test_equity_curve_legacy_and_missing(spark):
    df = spark.createDataFrame(
        [(day(0), -0.10, None, None, True), (day(1), None, -0.05, 0.02, False), (day(2), 0.02, -0.01, None, False), (day(3), 0.01, None, None, False)],
        "session date, raw_oc double, pub_oc double, pub_cost double, legacy boolean")
    got = {(r.rule, r.session): r.level for r in R.equity_curve(df, 0.01).collect()}
    assert [round(got["raw", day(i)], 6) for i in range(4)] == [0.09, 0.09, 0.06, 0.04]
    assert [round(got["published", day(i)], 6) for i in range(4)] == [0.09, 0.12, 0.12, 0.12]


def brute_auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("bound", [1000, 10**9])
def test_auc(spark, bound):
    rnd = random.Random(9)
    data = [(round(rnd.random(), 1), rnd.random() < 0.4) for _ in range(300)]
    df = spark.createDataFrame(data, "s double, y boolean").withColumn("m", F.lit("a"))
    ask = {"auc": (F.col("y"), F.lit(True)), "high": (F.col("y"), F.col("s") > 0.3)}
    got = R.aucs(df, ["m"], "s", ask, bound).first()
    flipped = R.aucs(df.withColumn("s", -F.col("s")), ["m"], "s", {"auc": ask["auc"]}, bound).first()
    assert got.auc == pytest.approx(brute_auc(data)) and flipped.auc == pytest.approx(1 - got.auc)
    assert got.high == pytest.approx(brute_auc([x for x in data if x[0] > 0.3]))


def test_calibration_counts(spark):
    df = spark.createDataFrame([("m", day(i % 5), i, i / 97, -0.1 if i % 3 else 0.1) for i in range(97)],
                               "model string, session date, symbol long, score double, next_oc double")
    for bound in (1000, 10**9):
        got = R.calibration(df, 10, bound).orderBy("bin").collect()
        assert sum(r.n for r in got) == 97 and len(got) == 10 and all(a.pred < b.pred for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.3), (3, 10, 0.3), (10, 10, 0.5), (40, 400, 0.2), (5, 9000, 0.01)])
def test_binomial_tail(spark, k, n, p):
    df = spark.createDataFrame([(k, n, p)], "k long, n long, p double")
    got = df.select(R.binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("t")).first().t
    want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
    assert got == pytest.approx(min(1, want), rel=1e-6, abs=1e-12)


def test_wilson_holds_the_share(spark):
    df = spark.createDataFrame([(0.0, 10.0), (0.3, 50.0), (1.0, 5.0)], "p double, n double")
    lo, hi = R.wilson(F.col("p"), F.col("n"))
    for r in df.select("p", lo.alias("lo"), hi.alias("hi")).collect():
        assert -1e-9 <= r.lo <= r.p + 1e-9 and r.p - 1e-9 <= r.hi <= 1 + 1e-9


def test_missing_outcomes_are_not_misses(spark):
    df = spark.createDataFrame([(-0.06, 0.0, None), (0.0, 0.3, -0.2), (None, None, None)], "next_oc double, next_oh double, swing5 double")
    got = R.outcome_rates(df).first()
    assert (got.dump, got.squeeze, got.swing, got.pump, got.n) == (0.5, 0.5, 1.0, 0.0, 2)


def test_ruinous_day_has_no_multiple(spark):
    df = spark.createDataFrame([(0.1, 0.0), (12.0, 0.0)], "next_oc double, cost double")
    assert R.trade_sim(df).first().compounded is None
    assert R.trade_sim(df.filter("next_oc < 1")).first().compounded == pytest.approx(0.99)


def test_band_blend_rules(spark):
    rows_ = spark.createDataFrame([("s", 1, 1), ("s", 2, 5), ("s", 3, 200), ("s", 4, None)], "session string, rank int, urank int")
    rep = spark.createDataFrame([(1, 1, .6, -.03, .1, None, .01, .02), (2, 10, .4, -.02, .1, .2, None, .02), (11, 100, None, None, None, None, None, None)],
                                "lo int, hi int, hit double, mean_oc double, squeeze double, pump double, net double, cost double")
    got = {r.band_lo: r for r in R.band_blend(rows_, rep).collect()}
    assert got[1].pump == 0.0 and got[1].net == .01 and got[1].watchlist is False
    assert (got[2].n, got[2].hit, got[2].net, got[2].urank_min, got[2].urank_max) == (1, .4, None, 5, 200)
    assert got[2].watchlist is False
    weak = {r.band_lo: r.watchlist for r in R.band_blend(rows_, rep, cost=0.025, sized=False).collect()}
    assert weak == {1: False, 2: True}


def test_importance_prefers_m1(spark):
    t = spark.createDataFrame([("m0", "flow", 1.0), ("m1", "flow", 2.0), ("m1", "flow", 3.0), ("m1", "decay", None)], "model string, family string, importance double")
    assert rows(R.family_importance(t)) == [("flow", 5.0, "m1")]
    assert rows(R.family_importance(t.filter("model = 'm0'"))) == [("flow", 1.0, "m0")]
