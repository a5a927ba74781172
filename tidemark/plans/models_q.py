"""Models (L) on the weekly bars: fitted with pyspark.ml, graded out of sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import features, models
from ..session import cut
from ..sources import derived
from . import board
from .ctes import r6
from .records_q import _SCORES, model_scores
from .registry import query, r


def training(spark, d):
    rows = models.with_session_index(features.session_features(derived.bars(spark, d, "week")))
    return models.stored(models.training_rows(rows))


def calendar(rows):
    """First session index after two thirds of the calendar, and the calendar's end (two scalars)."""
    lo, hi = rows.agg(F.min("session_idx"), F.max("session_idx")).first()
    return lo + 2 * (hi - lo) // 3, hi + 1


@query("l1_walk_forward")
def l1(spark, d):
    rows = training(spark, d)
    n = calendar(rows)[1]
    out = models.walk_forward(rows, models.M0, "y_dump", 3, n)
    return out.select("session", "symbol", "session_idx", "fold", "trained_before", r("p"), r("next_oc"))


@query("l2_outcome_models")
def l2(spark, d):
    rows = training(spark, d)
    out = models.outcome_models(rows, {"m0": models.M0, "m1": models.M1}, calendar(rows)[0])
    return out.select("session", "symbol", "model", *[r(f"prob_{n}") for n in models.targets()])


TREES = {"rounds": 8, "depth": 3}


@query("l2_boosted_trees")
def l2_trees(spark, d):
    """Odds of every target from boosted trees, on the same sessions as the logistic models."""
    rows = training(spark, d)
    out = models.outcome_models(rows, {"m0": models.M0}, calendar(rows)[0], trees=TREES)
    return out.select("session", "symbol", "model", *[r(f"prob_{n}") for n in models.targets()])


@query("l3_prob_cap", f"""
    WITH {_SCORES}, placed AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, session, symbol) AS i,
      ceil(count(*) OVER (PARTITION BY model) * 0.01) AS top FROM scores),
    caps AS (SELECT model, avg(CASE WHEN next_oc <= -0.05 THEN 1.0 ELSE 0.0 END) AS cap FROM placed WHERE i <= top GROUP BY model)
    SELECT session, symbol, model, {r6('least(score, cap)', 'p_capped', 9)}, score > cap AS was_capped FROM scores JOIN caps USING (model)""", "scored")
def l3(spark, d):
    scores = cut(model_scores(spark, d))
    out = models.capped(scores, models.probability_caps(scores, 0.01))
    return out.select("session", "symbol", "model", r("p_capped", places=9), (F.col("score") > F.col("cap")).alias("was_capped"))


@query("l4_permutation_importance")
def l4(spark, d):
    rows = training(spark, d)
    at = calendar(rows)[0]
    model = models.fit(models.span(rows, None, at - 5), models.M0, "y_dump")
    test = models.span(rows, at, None).filter(F.col("y_dump").isNotNull())
    out = models.permutation_importance(lambda x: models.score(model, x), test, models.FAMILY_OF, "y_dump", 7, small=True)
    return out.select("family", r("auc"), r("importance"))


@query("l5_attribution")
def l5(spark, d):
    rows = training(spark, d)
    at = calendar(rows)[0]
    model = models.fit(models.span(rows, None, at - 5), models.M0, "y_dump")
    out = models.attribution(*models.weights(model), models.span(rows, at, None), models.FAMILY_OF, small=True)
    return out.select("session", "symbol", r("p"), *[r(f) for f in models.FAMILY_OF])


@query("l6_expected_oc")
def l6(spark, d):
    rows = training(spark, d)
    out = models.expected_move(rows, models.M0, calendar(rows)[0], 5, small=True)
    return out.select("session", "symbol", r("exp_oc"), r("liq_edge"))


# What SQL can express of the fitted queries: their rows, folds and labels, and the same operators
# on stated coefficients or on one input.

STATED = {"r1": -1.0, "r5": 0.5, "rsi14": 0.01, "rvol1": 0.125, "short_ratio_5d": 0.25, "dist_ma20": -2.0, "dd_52w": 0.5, "vol20": 4.0}
STATED_AT = -1.0
_BOUNDS = {"dump": ("next_oc", "<=", fixed.DUMP), "squeeze": ("next_oh", ">=", fixed.SQUEEZE), "pump": ("next_oc", ">=", fixed.PUMP),
           "bigdump": ("next_oc", "<=", fixed.BIG_DUMP), "swing": ("swing5", "<=", fixed.SWING)}
_LABELS = ", ".join(f"CAST(CASE WHEN {c} {op} {v}::DOUBLE THEN 1 WHEN {c} IS NOT NULL THEN 0 END AS DOUBLE) AS y_{n}" for n, (c, op, v) in _BOUNDS.items())
_TRAINING = f"""training AS (SELECT *, {_LABELS} FROM (SELECT *, dense_rank() OVER (ORDER BY session) - 1 AS session_idx FROM panel_w)
      WHERE {' AND '.join(f'{c} IS NOT NULL' for c in models.M0)}),
    cutoff AS (SELECT min(session_idx) + 2 * (max(session_idx) - min(session_idx)) // 3 AS at, max(session_idx) + 1 AS n FROM training)"""


def _odds_sql(swapped=(), own="t", other="m"):
    terms = "".join(f" + {w}::DOUBLE * {other if c in swapped else own}.{c}" for c, w in STATED.items())
    return f"1 / (1 + exp(-({STATED_AT}::DOUBLE{terms})))"


@query("l1_folds", f"""
    WITH {_TRAINING}, steps AS (SELECT greatest(1, n // 4) AS step FROM cutoff)
    SELECT session, symbol, session_idx, CAST(least(3, session_idx // step) AS INTEGER) AS fold, CAST(least(3, session_idx // step) * step - 5 AS INTEGER) AS trained_before
    FROM training, steps WHERE session_idx >= step""", "panel_w")
def l1_folds(spark, d):
    """Which rows the walk forward scores, in which fold, and how far their model's training reached."""
    return l1(spark, d).select("session", "symbol", "session_idx", "fold", "trained_before")


@query("l2_labels", f"WITH {_TRAINING} SELECT session, symbol, session_idx, {', '.join(f'y_{n}' for n in _BOUNDS)} FROM training", "panel_w")
def l2_labels(spark, d):
    """Rows and labels the outcome models learn from."""
    return training(spark, d).select("session", "symbol", "session_idx", *[f"y_{n}" for n in models.targets()])


@query("l4_stated_model", f"""
    WITH {_TRAINING}, tested AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY symbol) AS i,
        row_number() OVER (PARTITION BY session ORDER BY md5(symbol || ':7'), symbol) AS j FROM training, cutoff WHERE session_idx >= cutoff.at AND y_dump IS NOT NULL),
    cases AS (SELECT 'none' AS family, round({_odds_sql()}, 9) AS p, y_dump FROM tested t
      {' '.join(f"UNION ALL SELECT '{f}', round({_odds_sql(cs)}, 9), t.y_dump FROM tested t JOIN tested m ON t.session = m.session AND t.i = m.j" for f, cs in models.FAMILY_OF.items())}),
    tally AS (SELECT family, p, count(*) FILTER (y_dump = 1) AS pos, count(*) FILTER (y_dump = 0) AS neg FROM cases GROUP BY family, p),
    aucs AS (SELECT family, sum(pos * (below - 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM (
      SELECT *, sum(neg) OVER (PARTITION BY family ORDER BY p) AS below FROM tally) GROUP BY family)
    SELECT family, {r6('auc')}, {r6("(SELECT auc FROM aucs WHERE family = 'none') - auc", 'importance')} FROM aucs WHERE family <> 'none'""", "panel_w")
def l4_stated(spark, d):
    """Importance of the families of a model with stated coefficients."""
    rows = training(spark, d)
    test = models.span(rows, calendar(rows)[0], None).filter(F.col("y_dump").isNotNull())
    scorer = lambda x: x.withColumn("p", models.logistic(STATED, STATED_AT))
    return models.permutation_importance(scorer, test, models.FAMILY_OF, "y_dump", 7, small=True).select("family", r("auc"), r("importance"))


@query("l5_stated_model", f"""
    WITH {_TRAINING}, t AS (SELECT * FROM training, cutoff WHERE session_idx >= cutoff.at),
    m AS (SELECT session, {', '.join(f'median({c}) AS {c}' for c in STATED)} FROM t GROUP BY session),
    odds AS (SELECT t.session, t.symbol, {_odds_sql()} AS p, {', '.join(f'{_odds_sql(cs)} AS p_{f}' for f, cs in models.FAMILY_OF.items())} FROM t JOIN m ON t.session = m.session),
    drops AS (SELECT session, symbol, p, {', '.join(f'greatest(p - p_{f}, 0) AS {f}' for f in models.FAMILY_OF)} FROM odds)
    SELECT session, symbol, {r6('p')}, {', '.join(r6(f"coalesce({f} / nullif({' + '.join(models.FAMILY_OF)}, 0), 0)", f) for f in models.FAMILY_OF)} FROM drops""", "panel_w")
def l5_stated(spark, d):
    """Attribution of the readings of a model with stated coefficients."""
    rows = training(spark, d)
    families = {f: [c for c in cs if c in STATED] for f, cs in models.FAMILY_OF.items()}
    out = models.attribution(STATED, STATED_AT, models.span(rows, calendar(rows)[0], None), families, small=True)
    return out.select("session", "symbol", r("p"), *[r(f) for f in models.FAMILY_OF])


#: Stumps and one deeper tree, as a fit would give them.
STUMPS = models.Trees(["vol20", "r1", "rsi14", "dd_52w"], [
    (1.0, ("vol20", 0.125, -0.5, ("r1", 0.0, 0.25, -0.125))), (0.5, ("rsi14", 50.0, 0.25, -0.25)), (0.25, ("dd_52w", -0.25, 1.0, ("rsi14", 40.0, 0.5, -1.0)))])


def _stumps_sql(node):
    if not isinstance(node, tuple):
        return f"{node}::DOUBLE"
    name, threshold, left, right = node
    return f"CASE WHEN {name} <= {threshold}::DOUBLE THEN {_stumps_sql(left)} ELSE {_stumps_sql(right)} END"


@query("l2_stated_trees", f"""
    WITH {_TRAINING} SELECT session, symbol, {r6('1 / (1 + exp(-2 * (' + ' + '.join(f'{w}::DOUBLE * ({_stumps_sql(t)})' for w, t in STUMPS.trees) + ')))', 'p')}
    FROM training, cutoff WHERE session_idx >= cutoff.at""", "panel_w")
def l2_stated_trees(spark, d):
    """Odds of stated trees, by the scoring that fitted ones get."""
    rows = training(spark, d)
    return models.score(STUMPS, models.span(rows, calendar(rows)[0], None)).select("session", "symbol", r("p"))


@query("l6_one_input", f"""
    WITH {_TRAINING}, known AS (SELECT *, rank() OVER (PARTITION BY session ORDER BY next_oc) AS i, count(*) OVER (PARTITION BY session) AS of FROM training WHERE next_oc IS NOT NULL),
    placed AS (SELECT session_idx, r1, next_oc, CASE WHEN of > 1 THEN (i - 1) / (of - 1)::DOUBLE ELSE 0 END - 0.5::DOUBLE AS place FROM known),
    line AS (SELECT regr_slope(next_oc, r1) AS b, regr_intercept(next_oc, r1) AS a, regr_slope(place, r1) AS pb, regr_intercept(place, r1) AS pa
      FROM placed, cutoff WHERE session_idx < cutoff.at - 5)
    SELECT session, symbol, {r6('a + b * r1', 'exp_oc')}, {r6('-(pa + pb * r1)', 'liq_edge')} FROM training, cutoff, line WHERE session_idx >= cutoff.at""", "panel_w")
def l6_one(spark, d):
    """Expected move and place from the last move alone, least squares without a penalty."""
    rows = training(spark, d)
    out = models.expected_move(rows, ["r1"], calendar(rows)[0], 5, penalty=0.0, small=True)
    return out.select("session", "symbol", r("exp_oc"), r("liq_edge"))
