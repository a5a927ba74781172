import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import models
from tidemark.plans import models_q
from tidemark.sources import derived


def test_walk_forward_never_sees_the_block(spark, sf):
    out = entry.queries()["l1_walk_forward"](spark, sf)
    assert out.count() > 0
    assert out.filter(F.col("trained_before") > F.col("session_idx") - 5).count() == 0
    assert out.groupBy("session", "symbol").count().filter("count > 1").count() == 0


def test_odds_are_probabilities(spark, sf):
    out = entry.queries()["l2_outcome_models"](spark, sf)
    for n in models.targets():
        lo, hi = out.agg(F.min(f"prob_{n}"), F.max(f"prob_{n}")).first()
        assert 0 <= lo <= hi <= 1
    assert {r.model for r in out.select("model").distinct().collect()} == {"m0", "m1"}


def test_odds_are_no_worse_than_the_base_rate(spark, sf):
    """Log-loss out of sample against the constant odds of the training sessions, two hundredths of leave."""
    rows = models_q.training(spark, sf)
    at = models_q.calendar(rows)[0]
    base = rows.filter(F.col("session_idx") < at - 5).agg(F.avg("y_dump")).first()[0]
    loss = lambda p: F.avg(-F.when(F.col("y_dump") == 1, F.log(p)).otherwise(F.log(1 - p)))
    scored = models.outcome_models(rows, {"m0": models.M0}, at, names=("dump",)).filter("y_dump IS NOT NULL")
    fitted, constant = scored.agg(loss(F.col("prob_dump")), loss(F.lit(base))).first()
    assert fitted < constant + 0.02


def test_cap_holds(spark, sf):
    from tidemark.plans.records_q import model_scores
    scores = model_scores(spark, sf)
    caps = models.probability_caps(scores, 0.01, 10**6)
    out = models.capped(scores, caps)
    assert out.filter(F.col("p_capped") > F.col("cap")).count() == 0


def test_shuffle_keeps_each_sessions_values(spark, sf):
    rows = models_q.training(spark, sf)
    mixed = models.shuffled(rows, ["vol20"], 7, 100)
    assert mixed.count() == rows.count()
    a = rows.groupBy("session").agg(F.round(F.sum("vol20"), 9).alias("s"))
    assert a.exceptAll(mixed.groupBy("session").agg(F.round(F.sum("vol20"), 9).alias("s"))).count() == 0
    assert mixed.join(rows, ["session", "symbol", "vol20"]).count() < rows.count()


def test_attribution_shares(spark, sf):
    out = entry.queries()["l5_attribution"](spark, sf)
    total = sum((F.col(f) for f in models.FAMILY_OF), F.lit(0.0))
    assert out.filter((F.abs(total - 1) > 1e-4) & (F.abs(total) > 1e-9)).count() == 0


def test_importance_is_the_auc_lost(spark, sf):
    out = entry.queries()["l4_permutation_importance"](spark, sf).collect()
    assert {r.family for r in out} == set(models.FAMILY_OF)
    intact = {round(r.auc + r.importance, 5) for r in out}
    assert len(intact) == 1 and all(0 <= r.auc <= 1 for r in out)


def test_expected_move_is_known_for_every_scored_row(spark, sf):
    out = entry.queries()["l6_expected_oc"](spark, sf)
    assert out.count() > 0 and out.filter("exp_oc IS NULL OR liq_edge IS NULL").count() == 0
    assert out.agg(F.max(F.abs("liq_edge"))).first()[0] < 2


def test_wrong_digests_are_found(spark, sf):
    out = entry.queries()["s6_feed_integrity"](spark, sf).collect()
    assert out and all(r.ok == (r.name[5:7] != "03") for r in out)


def test_the_newest_session_is_scored(spark, sf):
    """Inputs of the pre-market models are missing there; the models without them score it."""
    from tidemark.operators import features, models as M
    panel = M.with_session_index(features.session_features(derived.bars(spark, sf, "week")))
    rows = M.training_rows(panel)
    last = panel.dropna(subset=M.M0).agg({"session_idx": "max"}).first()[0]
    assert rows.agg({"session_idx": "max"}).first()[0] == last
    newest = rows.filter(rows.session_idx == last)
    assert newest.filter("next_gap IS NULL").count() == newest.count() > 0
