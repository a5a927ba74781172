"""Scoring at scale with pyspark.ml. All formulas here are our choices.

The training table is written once by blocks of sessions (`stored`) and every fit reads its blocks of the written
copy. Fits are distributed; the driver holds only coefficients. A row with a
missing feature is not scored, never filled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import and_, or_

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import cut, fresh_path
from .boosting import boost
from .ranking import beside, exact_median, place_in_ties, with_group_agg, with_percent_rank, with_row_number
from .records import aucs, by_score

M0 = ["r1", "r3", "r5", "r20", "rvol1", "rsi14", "dist_ma20", "dist_ma50", "dd_52w", "vol20", "short_ratio_5d"]
M1 = [*M0, "next_gap"]
FAMILY_OF = {
    "structure": ["vol20"], "exhaustion": ["r1", "r3", "r5", "r20", "rsi14"], "decay": ["dist_ma20", "dist_ma50", "dd_52w"],
    "flow": ["rvol1", "short_ratio_5d"],
}


def targets() -> dict[str, Column]:
    """Outcome labels of the session after the features (and the five after, for swing)."""
    return {
        "dump": F.col("next_oc") <= fixed.DUMP, "squeeze": F.col("next_oh") >= fixed.SQUEEZE,
        "pump": F.col("next_oc") >= fixed.PUMP, "bigdump": F.col("next_oc") <= fixed.BIG_DUMP,
        "swing": F.col("swing5") <= fixed.SWING,
    }


def training_rows(panel: DataFrame, needed: Sequence[str] = tuple(M0)) -> DataFrame:
    """Rows with all of `needed`, the inputs of every model, and one 0/1 column per target (missing where not known yet).

    Inputs that only some models take may be missing; those models pass over such rows.
    """
    rows = panel.withColumn("next_gap", F.col("next_open") / F.col("close") - 1)
    labels = [F.when(c, 1.0).when(~c, 0.0).alias(f"y_{n}") for n, c in targets().items()]
    return rows.dropna(subset=list(needed)).select(
        "session", "symbol", *M1, "next_oc", "next_oh", "swing5", "session_idx", *labels)


def with_session_index(rows: DataFrame) -> DataFrame:
    """0-based number of the session in the calendar (one row per session is numbered)."""
    days = rows.select("session").distinct().withColumn(
        "session_idx", F.row_number().over(W.orderBy("session")).cast("bigint") - 1)
    return rows.join(F.broadcast(days), "session")


BLOCK = 20


def stored(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The training rows written by blocks of `block` sessions, so that a span of sessions reads its own blocks only."""
    spark = rows.sparkSession
    path = fresh_path(spark, "training")
    placed = rows.withColumn("block", F.floor(F.col("session_idx") / block).cast("int"))
    placed.hint("rebalance", "block").write.partitionBy("block").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def span(rows: DataFrame, start: int | None, end: int | None, block: int = BLOCK) -> DataFrame:
    """Rows of the sessions start <= session_idx < end; of stored rows only the blocks that hold them are read."""
    if start is not None:
        rows = rows.filter(F.col("session_idx") >= start)
    if end is not None:
        rows = rows.filter(F.col("session_idx") < end)
    if "block" not in rows.columns:
        return rows
    if start is not None:
        rows = rows.filter(F.col("block") >= start // block)
    return rows if end is None else rows.filter(F.col("block") <= (end - 1) // block)


def fit(rows: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    steps = [VectorAssembler(inputCols=list(features), outputCol="x", handleInvalid="skip"),
             LogisticRegression(featuresCol="x", labelCol=label, maxIter=20, regParam=0.01, probabilityCol="prob",
                                rawPredictionCol="raw", predictionCol="pred")]
    return Pipeline(stages=steps).fit(rows.filter(F.col(label).isNotNull()))


#: Logistic models fitted at once. A pass over the rows ends on its last tasks, and the other fit takes the cores that wait;
#: each fit holds its rows in memory as blocks while it runs.
FITS = 2


def fit_all(rows: DataFrame, sets: Mapping[str, Sequence[str]], labels: Sequence[str]) -> dict[tuple[str, str], PipelineModel]:
    """A logistic model of every label from every feature set, `FITS` of them at a time."""
    with ThreadPool(FITS) as pool:
        run = inheritable_thread_target(rows.sparkSession)(lambda m, c: ((m, c), fit(rows, sets[m], c)))
        return dict(pool.starmap(run, [(m, c) for m in sets for c in labels], chunksize=1))


def known(inputs: Sequence[str]) -> Column:
    """Whether a row has all inputs, as a `VectorAssembler` that skips the others sees it."""
    return reduce(and_, [F.col(c).isNotNull() & ~F.isnan(c) for c in inputs])


class Trees:
    """Boosted trees as one column of nested conditions: scored in generated code, without assembling vectors.

    The trees' values are an array that is summed by a function over arrays, and not one sum: Spark then cuts their code
    into methods the JVM compiles. As one method, five targets' trees are beyond the length it compiles and run interpreted.
    A row that lacks an input has no odds. `trees` holds (weight, node); a node is a leaf's value or
    (input, threshold, left, right), left where the input is at most the threshold. Odds are 1 / (1 + exp(-2 margin)).
    """

    def __init__(self, inputs: Sequence[str], trees: Sequence[tuple[float, tuple | float]]):
        self.inputs, self.trees = list(inputs), list(trees)

    def odds(self) -> Column:
        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, threshold, left, right = node
            return F.when(F.col(name) <= F.lit(float(threshold)), value(left)).otherwise(value(right))

        values = F.array(*[F.lit(float(w)) * value(root) for w, root in self.trees])
        margin = F.aggregate(values, F.lit(0.0), lambda total, v: total + v)
        return F.when(known(self.inputs), 1 / (1 + F.exp(-2 * margin)))


def fit_trees_of(rows: DataFrame, features: Sequence[str], labels: Sequence[str], rounds: int = 10, depth: int = 3, bins: int = 32, seed: int = 7) -> dict[str, Trees]:
    """Gradient-boosted trees of several targets from the same passes over the rows; the driver holds sums by bin and the trees alone."""
    some = reduce(or_, [F.col(c).isNotNull() for c in labels])
    fitted = boost(rows.filter(known(features) & some), features, labels, rounds, depth, bins, 0.3, seed)
    return {c: Trees(features, trees) for c, trees in zip(labels, fitted, strict=True)}


def fit_trees(rows: DataFrame, features: Sequence[str], label: str, rounds: int = 10, depth: int = 3, bins: int = 32, seed: int = 7) -> Trees:
    """Gradient-boosted trees of one target."""
    return fit_trees_of(rows, features, [label], rounds, depth, bins, seed)[label]


def score(model: PipelineModel | Trees, rows: DataFrame, name: str = "p") -> DataFrame:
    """Rows that have all inputs of the model, with their odds. They are tested for the inputs, not for the odds, which Spark would compute twice."""
    if isinstance(model, Trees):
        return rows.filter(known(model.inputs)).withColumn(name, model.odds())
    coef, intercept = weights(model)
    return rows.filter(known(list(coef))).withColumn(name, logistic(coef, intercept))


def weights(model: PipelineModel) -> tuple[dict[str, float], float]:
    """Coefficient per input, and the intercept, of a fitted logistic model."""
    lr, names = model.stages[-1], model.stages[0].getInputCols()
    return dict(zip(names, lr.coefficients.toArray().tolist())), float(lr.intercept)


def logistic(coef: Mapping[str, float], intercept: float, column: Callable[[str], Column] = F.col) -> Column:
    """Odds from stated coefficients; a missing input gives missing odds."""
    z = sum((F.lit(float(w)) * column(c) for c, w in coef.items()), F.lit(float(intercept)))
    return 1 / (1 + F.exp(-z))


def outcome_models(rows: DataFrame, sets: Mapping[str, Sequence[str]], cut_idx: int, embargo: int = 5,
                   names: Sequence[str] = ("dump", "squeeze", "pump", "bigdump", "swing"),
                   trees: Mapping[str, int] | None = None) -> DataFrame:
    """L2: odds of every target from every feature set, trained before the cut and scored from it.

    Logistic models, or boosted trees where `trees` gives their settings (may be empty).
    """
    train, test = span(rows, None, cut_idx - embargo), span(rows, cut_idx, None)
    labels = {n: f"y_{n}" for n in names}
    if trees is None:
        fitted = fit_all(train, sets, list(labels.values()))
    else:
        fitted = {(m, c): t for m, features in sets.items() for c, t in fit_trees_of(train, features, list(labels.values()), **trees).items()}
    out = None
    for model in sets:
        scored = test
        for n, c in labels.items():
            scored = score(fitted[model, c], scored, f"prob_{n}")
        part = scored.withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part)
    return out


def walk_forward(rows: DataFrame, features: Sequence[str], label: str, folds: int, n_sessions: int, embargo: int = 5,
                 trees: Mapping[str, int] | None = None) -> DataFrame:
    """L1: expanding folds; each block of sessions is scored by a model that saw only sessions
    at least `embargo` before it. Every row carries the last session its model was trained on."""
    step = max(1, n_sessions // (folds + 1))
    out = None
    for i in range(1, folds + 1):
        start, end = i * step, (i + 1) * step if i < folds else n_sessions
        model = fit(span(rows, None, start - embargo), features, label) if trees is None else fit_trees(span(rows, None, start - embargo), features, label, **trees)
        part = score(model, span(rows, start, end)).withColumns({"fold": F.lit(i), "trained_before": F.lit(start - embargo)})
        out = part if out is None else out.unionByName(part)
    return out


def probability_caps(scores: DataFrame, share: float = 0.01, small: bool = False) -> DataFrame:
    """L3: per model, the realised rate of its most confident calls out of sample; ties by session and symbol.

    Rows are counted per score first. Scores within the share count as a whole; only the rows of the one
    score that the share's end cuts are placed one by one.
    """
    if small:
        order = [F.col("score").desc(), F.col("session"), F.col("symbol")]
        placed = with_group_agg(with_row_number(scores, "model", order, "_i", True), "model", {"_n": F.count("*")}, True)
        return placed.filter(F.col("_i") <= F.ceil(F.col("_n") * share)).groupBy("model").agg(
            F.avg(F.when(F.col("next_oc") <= fixed.DUMP, 1.0).otherwise(0.0)).alias("cap"), F.count("*").alias("n_calls"))
    room = F.ceil(F.col("_all") * share) - (F.col("_upto") - F.col("_n"))          # rows of this score within the share
    held = cut(by_score(scores, "high").withColumn("_room", room).filter("_room > 0"))
    whole = held.filter("_room >= _n").select("model", "_n", "_hits")
    edge = held.filter("_room < _n").select("model", "score", "_room")               # one score a model at most
    ties = place_in_ties(beside(scores.select("model", "session", "symbol", "score", "next_oc"), edge, ["model", "score"]), "model", "score", "_tie")
    ties = ties.filter("_tie <= _room").select("model", F.lit(1).cast("bigint").alias("_n"),
                                               F.when(F.col("next_oc") <= fixed.DUMP, 1).otherwise(0).cast("bigint").alias("_hits"))
    return whole.unionByName(ties).groupBy("model").agg((F.sum("_hits") / F.sum("_n")).alias("cap"), F.sum("_n").alias("n_calls"))


def capped(scores: DataFrame, caps: DataFrame) -> DataFrame:
    """Odds kept at or below their model's cap (one row per model)."""
    return scores.join(F.broadcast(caps), "model").withColumn("p_capped", F.least("score", "cap"))


def shuffled(rows: DataFrame, cols: Sequence[str], seed: int, small: bool = False) -> DataFrame:
    """The columns exchanged among the names of each session by a seeded, repeatable order."""
    there = with_row_number(rows, "session", [F.col("symbol")], "_to", small)
    mixed = with_row_number(rows.select("session", "symbol", *cols), "session",
                            [F.md5(F.concat_ws(":", "symbol", F.lit(seed))), F.col("symbol")], "_to", small)
    return there.drop(*cols).join(mixed.drop("symbol"), ["session", "_to"]).drop("_to")


def permutation_importance(scorer: Callable[[DataFrame], DataFrame], rows: DataFrame, families: Mapping[str, Sequence[str]], label: str,
                           seed: int = 7, small: bool = False, all_small: bool = False) -> DataFrame:
    """L4: AUC lost when a family's inputs are exchanged among the names of a session. `scorer` adds the odds `p`."""
    cases = scorer(rows).select(F.lit("none").alias("family"), "p", label)
    for fam, cols in families.items():
        mixed = scorer(shuffled(rows, cols, seed, small))
        cases = cases.unionByName(mixed.select(F.lit(fam).alias("family"), "p", label))
    cases = cases.withColumn("p", F.round("p", 9))
    measured = aucs(cases, ["family"], "p", {"auc": (F.col(label) == 1, F.lit(True))}, all_small)
    intact = F.max(F.when(F.col("family") == "none", F.col("auc"))).over(W.partitionBy())     # one row per family
    return measured.withColumn("importance", intact - F.col("auc")).filter(F.col("family") != "none")


def attribution(coef: Mapping[str, float], intercept: float, rows: DataFrame, families: Mapping[str, Sequence[str]],
                small: bool = False) -> DataFrame:
    """Share of a reading that disappears when a family is set to the session's typical values.

    One pass: the linear score is recomputed per family from the coefficients.
    """
    cols = [c for cs in families.values() for c in cs]
    if small:
        typical = rows.groupBy("session").agg(*[F.median(c).alias(f"_t_{c}") for c in cols])
    else:
        typical = rows.select("session").distinct()
        for c in cols:
            typical = typical.join(exact_median(rows, "session", c, f"_t_{c}"), "session")
    met = rows.join(F.broadcast(typical), "session")          # one row per session of the calendar
    odds = lambda replaced: logistic(coef, intercept, lambda c: F.col(f"_t_{c}" if c in replaced else c))
    met = met.withColumn("p", odds(()))
    drops = {f: F.greatest(F.col("p") - odds(cs), F.lit(0.0)) for f, cs in families.items()}
    met = met.withColumns({f"_d_{f}": c for f, c in drops.items()})
    total = sum((F.col(f"_d_{f}") for f in families), F.lit(0.0))
    return met.select("session", "symbol", "p", *[
        F.coalesce(F.try_divide(F.col(f"_d_{f}"), total), F.lit(0.0)).alias(f) for f in families])


def expected_move(rows: DataFrame, features: Sequence[str], cut_idx: int, embargo: int = 5,
                  penalty: float = 0.001, small: bool = False) -> DataFrame:
    """Expected open-to-close, and expected place among the session's peers (edge = -prediction)."""
    placed = with_percent_rank(rows.filter(F.col("next_oc").isNotNull()), "session", "symbol", ["next_oc"], "_pr", small)
    placed = placed.withColumn("place", F.col("next_oc_pr") - 0.5)
    train, test = span(placed, None, cut_idx - embargo), span(rows, cut_idx, None)
    vec = VectorAssembler(inputCols=list(features), outputCol="x", handleInvalid="skip")
    out = vec.transform(test)
    for label, name in (("next_oc", "exp_oc"), ("place", "_place")):
        reg = LinearRegression(featuresCol="x", labelCol=label, predictionCol=name, maxIter=20, regParam=penalty)
        out = reg.fit(vec.transform(train)).transform(out)
    return out.withColumn("liq_edge", -F.col("_place")).drop("x", "_place")
