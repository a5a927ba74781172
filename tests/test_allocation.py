import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import allocation as A


def poured(total, caps):
    """Plain pouring, a little at a time, as the expected result."""
    alloc, rem = [0.0] * len(caps), float(total)
    while rem > 1e-9:
        open_ = [i for i, c in enumerate(caps) if c - alloc[i] > 1e-9]
        if not open_:
            break
        share = rem / len(open_)
        for i in open_:
            add = min(caps[i] - alloc[i], share)
            alloc[i] += add
            rem -= add
    return alloc, rem


@pytest.fixture(scope="module")
def portfolios():
    rnd = random.Random(11)
    out = []
    for p in range(120):
        caps = [rnd.choice([0.0, rnd.uniform(0, 1000), rnd.uniform(1000, 1e5)]) for _ in range(rnd.randint(1, 10))]
        out.append((p, rnd.choice([500.0, 1e4, 1e5, 1e6]), caps))
    return out


@pytest.mark.parametrize("small", [True, False])
def test_waterfill(spark, portfolios, small):
    data = [(p, t, i, c) for p, t, caps in portfolios for i, c in enumerate(caps)]
    df = spark.createDataFrame(data, "p int, total double, i int, cap double")
    got = {(r.p, r.i): r for r in A.waterfill(df, ["p"], ["i"], small=small).collect()}
    assert len(got) == len(data)
    for p, t, caps in portfolios:
        want, rem = poured(t, caps)
        for i, w in enumerate(want):
            assert got[p, i].alloc == pytest.approx(w, abs=1.0) and got[p, i].alloc <= caps[i] + 1e-6
            assert got[p, i].left_over == pytest.approx(rem, abs=1.0)
        assert sum(got[p, i].alloc for i in range(len(caps))) + got[p, 0].left_over == pytest.approx(t, abs=1e-3)


def test_plan_rules(spark):
    board = spark.createDataFrame(
        [("s", "A", 1, True, 5000.0, 900.0, 0.02, 0.01), ("s", "B", 2, False, 9e9, None, 0.02, 0.01), ("s", "C", 3, True, 8000.0, None, 0.02, 0.01),
         ("s", "D", 4, True, None, None, 0.02, 0.01), ("s", "E", 5, True, 2e6, 3e4, None, 0.01)],
        "session string, symbol string, rank int, publishable boolean, capacity double, breakeven double, c10 double, spread double"
    ).withColumn("next_oc", F.lit(0.0))
    plan = A.plan_basket(board, totals=[50000], ks=[3])
    got = {r.symbol: r for r in plan.collect()}
    assert set(got) == {"A", "C", "E"}
    assert got["A"].cap == 0 and got["A"].why == "breakeven" and got["A"].cost is None
    assert got["C"].alloc == 8000 and got["E"].alloc == 30000 and got["E"].cost is None
    s = A.plan_summary(plan).first()
    assert s.deployed == 38000 and s.left_over == 12000
    assert s.mean_cost == pytest.approx(8000 * (0.01 + 0.0001 * 8000 ** 0.5) / 38000)
