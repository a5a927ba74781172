"""Training rows by blocks of sessions, and boosted trees out of sample."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tidemark.operators import models
from tidemark.plans import models_q


@pytest.fixture(scope="module")
def planted(spark):
    """Moves that follow when two inputs lie on the same side: trees can tell, a linear model cannot."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        for s in range(60):
            a, b = rng.gauss(0, 1), rng.gauss(0, 1)
            p = 0.8 if a * b > 0 else 0.1
            rows.append((i, s, a, b, None if s == 0 and i % 7 == 0 else float(rng.random() < p)))
    return models.stored(spark.createDataFrame(rows, "session_idx long, symbol long, a double, b double, y double"), 10)


def log_loss(scored, p):
    return scored.filter("y is not null").agg(F.avg(-F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]


def bounds(df):
    """Block numbers the partition filters of the scan compare with."""
    found = re.search(r"PartitionFilters: \[([^\]]*)\]", plan_of(df)).group(1)
    return [int(x) for x in re.findall(r"block#\d+ [<>]= (\d+)", found)]


def test_spans_read_their_blocks(planted):
    part = models.span(planted, 25, 42, 10)
    assert sorted(bounds(part)) == [2, 4]
    assert {r[0] for r in part.select("session_idx").distinct().collect()} == set(range(25, 42))
    assert {r[0] for r in part.select("block").distinct().collect()} == {2, 3, 4}
    assert models.span(planted, None, None).count() == planted.count() == 3600
    assert models.span(planted, None, 20, 10).select("block").distinct().count() == 2
    assert models.span(planted, None, 0, 10).count() == 0


def test_every_fold_prunes(spark, sf, monkeypatch):
    rows = models_q.training(spark, sf)
    n = models_q.calendar(rows)[1]
    fitted, scored = [], []
    fit, score = models.fit, models.score
    monkeypatch.setattr(models, "fit", lambda r, *a: (fitted.append(r), fit(r, *a))[1])
    monkeypatch.setattr(models, "score", lambda m, r, *a: (scored.append(r), score(m, r, *a))[1])
    models.walk_forward(rows, models.M0, "y_dump", 3, n)
    assert len(fitted) == len(scored) == 3
    step = n // 4
    assert [bounds(r) for r in fitted] == [[(i * step - 6) // models.BLOCK] for i in (1, 2, 3)]
    assert [sorted(bounds(r)) for r in scored] == [[i * step // models.BLOCK, ((i + 1) * step - 1 if i < 3 else n - 1) // models.BLOCK] for i in (1, 2, 3)]


def test_trees_beat_the_base_rate_and_the_linear_model(planted):
    trees = models.walk_forward(planted, ["a", "b"], "y", 3, 60, trees={"rounds": 15, "depth": 3})
    linear = models.walk_forward(planted, ["a", "b"], "y", 3, 60)
    same = ["session_idx", "symbol", "fold", "trained_before"]
    assert trees.select(same).exceptAll(linear.select(same)).count() == 0 and trees.count() == linear.count() > 0
    base = planted.agg(F.avg("y")).first()[0]
    constant = log_loss(trees, F.lit(base))
    assert log_loss(trees, F.col("p")) < constant - 0.1
    assert log_loss(linear, F.col("p")) > constant - 0.02
    assert trees.filter((F.col("p") <= 0) | (F.col("p") >= 1)).count() == 0


def test_the_column_is_the_fitted_model(planted):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    train = models.span(planted, None, 40, 10).coalesce(1)
    mine = models.fit_trees(train, ["a", "b"], "y", rounds=5, depth=2)
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="x")
    model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=5, maxDepth=2, maxBins=32, stepSize=0.3, seed=7).fit(vec.transform(train.filter("y is not null")).select("x", "y"))
    test = models.span(planted, 40, None, 10)
    a = {(r.session_idx, r.symbol): r.p for r in models.score(mine, test).collect()}
    b = {(r.session_idx, r.symbol): r.p for r in model.transform(vec.transform(test)).withColumn("p", vector_to_array("probability")[1]).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-12
    assert "Python" not in plan_of(models.score(mine, test))


def test_trees_leave_out_rows_that_lack_an_input(spark):
    t = models.Trees(["a", "b"], [(1.0, ("a", 0.5, 1.0, -1.0)), (0.5, 2.0)])
    rows = spark.createDataFrame([(1, 0.5, 0.0), (2, 0.6, 0.0), (3, None, 0.0), (4, 0.1, None), (5, float("nan"), 1.0)], "i int, a double, b double")
    got = {r.i: r.p for r in models.score(t, rows).collect()}
    assert got == {1: pytest.approx(1 / (1 + math.exp(-4))), 2: pytest.approx(0.5)}


def test_boosted_odds_on_the_tape(spark, sf):
    """Every target, out of sample; two hundredths of leave against the constant odds of the training sessions."""
    rows = models_q.training(spark, sf)
    at = models_q.calendar(rows)[0]
    out = models.outcome_models(rows, {"m0": models.M0}, at, trees=models_q.TREES)
    for n in models.targets():
        lo, hi = out.agg(F.min(f"prob_{n}"), F.max(f"prob_{n}")).first()
        assert 0 <= lo <= hi <= 1
    assert out.count() == models.span(rows, at, None).count()
