"""Boosted trees of all targets in the same passes, against pyspark.ml one target at a time; scoring and fitting side by side."""

import random
import threading

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tidemark.operators import boosting, models


@pytest.fixture(scope="module")
def two(spark):
    """Two labels with rows they do not know, an input with few values and rows that lack an input."""
    rng = random.Random(5)
    rows = []
    for i in range(2000):
        a, b, c = rng.gauss(0, 1), float(rng.randrange(5)), rng.random()
        y = None if i % 11 == 0 else float(rng.random() < (0.8 if a * (c - 0.5) > 0 else 0.1))
        z = None if i % 7 == 0 else float(rng.random() < 0.2 * b)
        rows.append((i, None if i % 97 == 0 else a, float("nan") if i % 89 == 0 else b, c, y, z))
    return spark.createDataFrame(rows, "i int, a double, b double, c double, y double, z double").coalesce(1)


def test_all_targets_at_once_are_the_targets_one_by_one(two):
    vec = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x", handleInvalid="skip")
    joint = models.fit_trees_of(two, ["a", "b", "c"], ["y", "z"], rounds=5, depth=3)
    for c in ("y", "z"):
        known = vec.transform(two.filter(F.col(c).isNotNull())).select("x", c)
        one = GBTClassifier(featuresCol="x", labelCol=c, maxIter=5, maxDepth=3, maxBins=32, stepSize=0.3, seed=7).fit(known)
        want = {r.i: r.p for r in one.transform(vec.transform(two)).select("i", vector_to_array("probability")[1].alias("p")).collect()}
        got = {r.i: r.p for r in models.score(joint[c], two).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9


def test_passes_do_not_grow_with_the_targets(two, monkeypatch):
    """One pass a level and round, whatever the number of labels."""
    passes = []
    sums = boosting._sums
    monkeypatch.setattr(boosting, "_sums", lambda *a: (passes.append(1), sums(*a))[1])
    models.fit_trees_of(two, ["a", "c"], ["y", "z"], rounds=2, depth=2)
    assert len(passes) == 4


def test_more_rows_than_place_the_candidates(spark):
    """Every row counts for a split, also where the candidates come from some of them."""
    rows = spark.range(30_000).select((F.col("id") % 1000).cast("double").alias("a"), F.when(F.col("id") % 1000 < 500, 1.0).otherwise(0.0).alias("y"))
    (weight, (name, threshold, left, right)), = models.fit_trees(rows, ["a"], "y", rounds=1, depth=1).trees
    assert (weight, name) == (1.0, "a") and abs(threshold - 500) < 60
    below = np.arange(1000) <= threshold
    y = np.where(np.arange(1000) < 500, 1.0, -1.0)
    assert left == pytest.approx(y[below].mean()) and right == pytest.approx(y[~below].mean())


def test_a_label_without_rows_is_refused(two):
    with pytest.raises(ValueError):
        models.fit_trees_of(two.withColumn("none", F.lit(None).cast("double")), ["a"], ["y", "none"])


def test_trees_are_not_scored_in_one_method(two):
    """Whole-stage code of many trees is one method, longer than the JVM compiles; such operators bear a star."""
    tree = models.Trees(["a", "c"], [(1.0, ("a", 0.5, 1.0, -1.0))] * 8)
    plan = plan_of(models.score(tree, two, "p")).splitlines()
    scoring = [x for x in plan if "Project" in x and "aggregate(" in x]
    assert scoring and not any("*(" in x for x in scoring)
    assert not any("Filter" in x and "aggregate(" in x for x in plan)


def test_logistic_odds_are_those_of_the_model(two):
    model = models.fit(two, ["a", "b", "c"], "y")
    got = models.score(model, two)
    assert "UDF" not in plan_of(got)
    want = {r.i: r.p for r in model.transform(two).select("i", vector_to_array("prob")[1].alias("p")).collect()}
    have = {r.i: r.p for r in got.collect()}
    assert have.keys() == want.keys() and max(abs(have[k] - want[k]) for k in want) < 1e-12


def test_logistic_models_are_fitted_side_by_side(two, monkeypatch):
    both = threading.Barrier(2, timeout=20)
    fit = models.fit
    monkeypatch.setattr(models, "fit", lambda *a: (both.wait(), fit(*a))[1])
    rows = two.withColumns({"session_idx": F.col("i") % 50, "y_y": F.col("y"), "y_z": F.col("z")})
    out = models.outcome_models(rows, {"m": ["a", "c"]}, 40, names=("y", "z"))
    assert out.count() > 0 and out.filter("prob_y is null or prob_z is null").count() == 0


def test_candidates_are_those_of_pyspark_beyond_the_rows_that_place_them(spark):
    """Of more than 10,000 rows pyspark.ml draws some; the same are drawn here, whatever other labels know."""
    rng = random.Random(9)
    rows = []
    for i in range(24_000):
        a, b = rng.gauss(0, 1), max(0.0, rng.gauss(0, 1))
        rows.append((i, a, b, float(rng.random() < (0.8 if a * (b - 0.4) > 0 else 0.1)), None if i % 5 == 0 else float(rng.random() < 0.3 + 0.1 * b)))
    data = spark.createDataFrame(rows, "i int, a double, b double, y double, z double").coalesce(2)
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="x", handleInvalid="skip")
    joint = models.fit_trees_of(data, ["a", "b"], ["y", "z"], rounds=3, depth=2)
    for c in ("y", "z"):
        known = vec.transform(data.filter(F.col(c).isNotNull())).select("x", c)
        one = GBTClassifier(featuresCol="x", labelCol=c, maxIter=3, maxDepth=2, maxBins=32, stepSize=0.3, seed=7).fit(known)
        want = {r.i: r.p for r in one.transform(vec.transform(data)).select("i", vector_to_array("probability")[1].alias("p")).collect()}
        got = {r.i: r.p for r in models.score(joint[c], data).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9


def test_equal_splits_go_to_the_first_input():
    n = np.array([[3, 1], [3, 1]])
    s = np.array([[0.1 + 0.2 + 0.3, 0.7], [0.3 + 0.2 + 0.1, 0.7]])          # the same three rows, added in another order
    assert boosting.best_split(n, s)[0] == boosting.best_split(n[::-1], s[::-1])[0] == (0, 0)
    assert boosting.best_split(np.array([[3, 4]]), np.array([[0.3, 0.4]]))[0] is None


def test_a_sample_larger_than_expected_gives_more_bins(spark, monkeypatch):
    monkeypatch.setattr(boosting, "sampled", lambda rows, share, seed: rows)
    rows = spark.range(24_000).select(F.col("id").cast("double").alias("a"), (F.col("id") >= 23_000).cast("double").alias("y"))
    (_, (_, threshold, _, right)), = models.fit_trees(rows, ["a"], "y", rounds=1, depth=1).trees
    assert abs(threshold - 23_000) < 320 and right > 0.6
