"""Records of ranked picks: rates, curves, studies, simulations.

Everything is grouped by something the calendar or the report bounds (session,
band, cohort, period) and aggregated before the shuffle. Rates skip missing
outcomes; a missing value is never counted as a miss.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import cut
from .ranking import agg_with_median, beside, place_in_ties, running_total, with_group_agg, with_row_number


def rate(cond: Column) -> Column:
    """Share of rows where `cond` holds; rows where it is unknown are left out."""
    return F.avg(share_of(cond))


def share_of(cond: Column) -> Column:
    """1 where `cond` holds, 0 where not, missing where it is unknown."""
    return F.when(cond, 1.0).when(~cond, 0.0)


def means(values: Mapping[str, Column]) -> tuple[dict[str, Column], list[Column]]:
    """Sums and counts of the known values, and their means: for aggregates that are summed more than once."""
    sums = {f"_s_{n}": c for n, c in values.items()} | {f"_c_{n}": F.when(c.isNotNull(), 1).otherwise(0) for n, c in values.items()}
    return sums, [F.try_divide(F.col(f"_s_{n}"), F.col(f"_c_{n}")).alias(n) for n in values]


def outcome_rates(rows: DataFrame, by: Sequence[str] = (), oc: str = "next_oc", oh: str = "next_oh",
                  swing: str = "swing5") -> DataFrame:
    """A1: share of name-days with each outcome."""
    return rows.groupBy(*by).agg(
        rate(F.col(oc) <= fixed.DUMP).alias("dump"), rate(F.col(oh) >= fixed.SQUEEZE).alias("squeeze"),
        rate(F.col(swing) <= fixed.SWING).alias("swing"), rate(F.col(oc) >= fixed.PUMP).alias("pump"),
        F.count(oc).alias("n"))


def in_subsets(rows: DataFrame, subsets: Mapping[str, Column], name: str = "subset") -> DataFrame:
    """One copy of each row per named condition it meets."""
    marked = F.explode(F.array(*[F.when(c, n) for n, c in subsets.items()]))
    return rows.withColumn(name, marked).filter(F.col(name).isNotNull())


def band_blend(rows: DataFrame, report: DataFrame, cost: float | None = None, sized: bool = True) -> DataFrame:
    """A2: per displayed board band, the report bands its rows' universe ranks fall in, averaged.

    A missing pump rate counts as 0; net and cost are averaged only where the
    report has both. `watchlist` marks a negative net, or where there is none (or
    the board is not `sized`) a mean move smaller than the cost (1% when unknown).
    A rank whose report band has no hit rate counts in the rank span only.
    """
    from .joins import band_join
    band = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in fixed.BOARD_BANDS])
    shown = rows.withColumn("_b", F.filter(band, lambda b: (F.col("rank") >= b["lo"]) & (F.col("rank") <= b["hi"]))[0])
    met = band_join(shown.filter(F.col("urank").isNotNull()), report, "urank")
    read = F.col("hit").isNotNull()
    both = read & F.col("net").isNotNull() & F.col("cost").isNotNull()
    mean = lambda c: F.avg(F.when(read, c))
    out = met.groupBy("session", F.col("_b.lo").alias("band_lo"), F.col("_b.hi").alias("band_hi")).agg(
        F.count_if(read).alias("n"), mean(F.col("hit")).alias("hit"), mean(F.col("mean_oc")).alias("mean_oc"),
        mean(F.col("squeeze")).alias("squeeze"), mean(F.coalesce("pump", F.lit(0.0))).alias("pump"),
        F.avg(F.when(both, F.col("net"))).alias("net"), F.avg(F.when(both, F.col("cost"))).alias("cost"),
        F.min("urank").alias("urank_min"), F.max("urank").alias("urank_max"))
    thin = (-F.col("mean_oc") < cost) if cost is not None else F.col("mean_oc") > -0.01
    by_net = F.col("net").isNotNull() & F.lit(sized)
    return out.withColumn("watchlist", F.when(by_net, F.col("net") < 0).otherwise(thin))


def family_importance(table: DataFrame) -> DataFrame:
    """A3: importance summed by family, from the m1 rows if there are any, else m0."""
    has_m1 = F.bool_or(F.col("model") == "m1").over(W.partitionBy())       # a report of a few rows
    chosen = table.withColumn("_m1", has_m1).filter(F.col("model") == F.when(F.col("_m1"), "m1").otherwise("m0"))
    return chosen.filter(F.col("importance").isNotNull()).groupBy("family").agg(
        F.sum("importance").alias("importance"), F.first("model").alias("model"))


def live_summary(rows: DataFrame, oc: str) -> DataFrame:
    """A4: down 5%+ so far, names and mean move of the board's top 25 and of ranks 26-100."""
    top, ext = F.col("rank") <= 25, F.col("rank").between(26, 100)
    part = lambda c, n: [
        F.count_if(c & (F.col(oc) <= fixed.DUMP)).alias(f"{n}_down5"), F.count_if(c).alias(f"{n}_n"),
        F.avg(F.when(c, F.col(oc))).alias(f"{n}_mean_oc")]
    return rows.groupBy("session").agg(*part(top, "top"), *part(ext, "ext"))


def equity_curve(daily: DataFrame, flat_cost: float) -> DataFrame:
    """A5: running sum of daily short results per rule.

    `daily`: session, raw_oc, pub_oc, pub_cost, legacy (a row of the old four-field
    shape has no published move and stands in the raw one). A missing day carries
    the level forward.
    """
    raw = -F.col("raw_oc") - flat_cost
    pub = F.when(F.col("pub_oc").isNotNull(), -F.col("pub_oc") - F.coalesce("pub_cost", F.lit(flat_cost))).when(
        F.col("legacy") & F.col("raw_oc").isNotNull(), raw)
    long = daily.select("session", F.explode(F.array(
        F.struct(F.lit("raw").alias("rule"), raw.alias("x")), F.struct(F.lit("published").alias("rule"), pub.alias("x")))).alias("e"))
    w = W.partitionBy("e.rule").orderBy("session").rowsBetween(W.unboundedPreceding, 0)   # one row per session
    return long.select("session", "e.rule", F.sum(F.coalesce("e.x", F.lit(0.0))).over(w).alias("level"))


def by_model(rows: DataFrame, models: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """Long form: one row per name-day and model, with that model's score."""
    return rows.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(c).alias("score")) for m, c in models.items()])).alias("_m")).select(
        *keep, "_m.model", "_m.score")


def cohort_rates(scores: DataFrame, small: bool = False) -> DataFrame:
    """Hit, mean move and squeeze rate of #1, top 10, top decile and all, per model."""
    order = [F.col("score").desc(), F.col("symbol")]
    ranked = running_total(scores, ["model", "session"], order, {"rank": F.lit(1)}, small, whole={"_n": "rank"})
    cohorts = in_subsets(ranked, {
        "top1": F.col("rank") == 1, "top10": F.col("rank") <= 10,
        "decile": F.col("rank") <= F.ceil(F.col("_n") / 10), "all": F.lit(True)}, "cohort")
    return cohorts.groupBy("model", "cohort").agg(
        F.count("*").alias("n"), rate(F.col("next_oc") <= fixed.DUMP).alias("hit"), F.avg("next_oc").alias("mean_oc"),
        rate(F.col("next_oh") >= fixed.SQUEEZE).alias("squeeze"))


def aucs(rows: DataFrame, by: Sequence[str], score: str, questions: Mapping[str, tuple[Column, Column]],
         small: bool = False) -> DataFrame:
    """Mann-Whitney AUC of the score, ties one half: name -> (positive, which rows count).

    Rows are first counted per distinct score, for all questions at once, so only
    distinct scores are ordered.
    """
    by = list(by)
    tally = lambda q, side: F.count_if(q[1] & (q[0] if side else ~q[0]))
    counts = rows.groupBy(*by, F.col(score).alias("_s")).agg(
        *[tally(q, True).alias(f"_p_{n}") for n, q in questions.items()],
        *[tally(q, False).alias(f"_q_{n}") for n, q in questions.items()])
    placed = running_total(counts, by, [F.col("_s")], {f"_below_{n}": F.col(f"_q_{n}") for n in questions}, small)

    def ratio(n: str) -> Column:
        p, q, below = F.col(f"_p_{n}"), F.col(f"_q_{n}"), F.col(f"_below_{n}")
        return F.try_divide(F.sum(p * (below - q + 0.5 * q)), F.sum(p) * F.sum(q).cast("double")).alias(n)

    return placed.groupBy(*by).agg(*[ratio(n) for n in questions])


def same_days(rows: DataFrame, rules: Mapping[str, Column], rank: str, value: str) -> DataFrame:
    """The value of each rule's first pick per session, on sessions where every rule has one."""
    days = rows.groupBy("session").agg(
        *[F.min_by(value, F.when(c, F.col(rank))).alias(n) for n, c in rules.items()])
    return days.dropna(subset=list(rules))


def brier(scores: DataFrame) -> DataFrame:
    """Mean squared error of the odds per model."""
    y = F.when(F.col("next_oc") <= fixed.DUMP, 1.0).otherwise(0.0)
    return scores.groupBy("model").agg(F.avg(F.pow(F.col("score") - y, F.lit(2.0))).alias("brier"), F.count("*").alias("n"))


def by_score(scores: DataFrame, first: str = "low") -> DataFrame:
    """Distinct scores per model with their rows `_n`, the rows up to them `_upto` (from the low or the high end) and of the model `_all`.

    Rows are counted per score before anything is sorted; `_hits` counts the dumps.
    """
    counts = scores.groupBy("model", "score").agg(F.count("*").alias("_n"), F.count_if(F.col("next_oc") <= fixed.DUMP).alias("_hits"),
                                                  F.count("next_oc").alias("_known"))
    order = F.col("score") if first == "low" else F.col("score").desc()
    placed = running_total(counts, "model", [order], {"_upto": F.col("_n")})
    return beside(placed, placed.groupBy("model").agg(F.sum("_n").alias("_all")), ["model"])


def calibration(scores: DataFrame, bins: int = 10, small: bool = False) -> DataFrame:
    """A10: predicted and actual rate per score decile and model; ties by session and symbol.

    A score whose rows all lie in one bin is counted as a whole; only the rows of scores that an edge cuts
    (one an edge at most) are placed one by one.
    """
    if small:
        order = [F.col("score"), F.col("session"), F.col("symbol")]
        placed = with_group_agg(with_row_number(scores, "model", order, "_i", True), "model", {"_n": F.count("*")}, True)
        binned = placed.withColumn("bin", F.floor((F.col("_i") - 1) * bins / F.col("_n")))
        return binned.groupBy("model", "bin").agg(
            F.avg("score").alias("pred"), rate(F.col("next_oc") <= fixed.DUMP).alias("actual"), F.count("*").alias("n"))
    scores = cut(scores.select("model", "session", "symbol", "score", "next_oc"))
    bin_of = lambda place: F.floor((place - 1) * bins / F.col("_all"))
    first = F.col("_upto") - F.col("_n") + 1
    held = cut(by_score(scores).withColumns({"bin": bin_of(first), "_last": bin_of(F.col("_upto"))}))
    whole = held.filter("bin = _last").select("model", "bin", "score", "_n", "_hits", "_known")
    edges = held.filter("bin <> _last").select("model", "score", first.alias("_first"), "_all")         # bins - 1 a model at most
    ties = beside(scores, edges, ["model", "score"])
    ties = place_in_ties(ties, "model", "score", "_tie").select(
        "model", bin_of(F.col("_first") + F.col("_tie") - 1).alias("bin"), "score", F.lit(1).cast("bigint").alias("_n"),
        F.when(F.col("next_oc") <= fixed.DUMP, 1).otherwise(0).cast("bigint").alias("_hits"), F.when(F.col("next_oc").isNotNull(), 1).otherwise(0).cast("bigint").alias("_known"))
    return whole.unionByName(ties).groupBy("model", "bin").agg(
        (F.sum(F.col("score") * F.col("_n")) / F.sum("_n")).alias("pred"), F.try_divide(F.sum("_hits"), F.sum("_known")).alias("actual"), F.sum("_n").alias("n"))


def rank_band_record(rows: DataFrame, bands: DataFrame, by: Sequence[str], value: str, cost: Column,
                     small: bool = False) -> DataFrame:
    """Walk-forward record per band of ranks; a rank counts in every band that holds it."""
    met = rows.withColumn("_cost", cost).join(
        F.broadcast(bands), (F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")))
    net = -F.col("next_oc") - F.col("_cost")
    sums, finals = means({
        "hit": share_of(F.col("next_oc") <= fixed.DUMP), "mean_oc": F.col("next_oc"), "squeeze": share_of(F.col("next_oh") >= fixed.SQUEEZE),
        "pump": share_of(F.col("next_oc") >= fixed.PUMP), "cost": F.col("_cost"), "net": net, "win": share_of(net > 0)})
    return agg_with_median(met, [*by, "lo", "hi"], {"n": F.lit(1).cast("bigint"), **sums}, ["n", *finals], "next_oc", "median_oc", small)


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95% score interval of a share (our choice of interval)."""
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half


def event_study(rows: DataFrame, setups: Mapping[str, Column], small: bool = False) -> DataFrame:
    """What followed each setup, against the baseline of all rows.

    tilt: down / up / both by whether the down and up rates exceed the baseline's
    (our rule).
    """
    held = in_subsets(rows.filter(F.col("next_oc").isNotNull()), {"baseline": F.lit(True), **setups}, "study")
    held = cut(held.select("study", "symbol", "next_oc", "swing5"))          # read for the sums and for the names
    sums, finals = means({"pct_dump": share_of(F.col("next_oc") <= fixed.DUMP), "pct_up5": share_of(F.col("next_oc") >= fixed.PUMP),
                          "pct_swing": share_of(F.col("swing5") <= fixed.SWING)})
    agg = agg_with_median(held, "study", {"n": F.lit(1).cast("bigint"), **sums}, ["n", *finals], "next_oc", "median_oc", small)
    agg = beside(agg, held.groupBy("study").agg(F.countDistinct("symbol").alias("n_symbols")), ["study"])
    # one row per study from here on
    of_base = lambda c: F.max(F.when(F.col("study") == "baseline", F.col(c))).over(W.partitionBy())
    agg = agg.select("*", of_base("pct_dump").alias("_bd"), of_base("pct_up5").alias("_bu"))
    bd, bu = F.col("_bd"), F.col("_bu")
    lo, hi = wilson(F.col("pct_dump"), F.col("n").cast("double"))
    down, up = F.col("pct_dump") > bd, F.col("pct_up5") > bu
    return agg.select(
        "*", lo.alias("ci_lo"), hi.alias("ci_hi"), F.try_divide(F.col("pct_dump"), bd).alias("lift_dump"),
        F.when(down & up, "both").when(down, "down").when(up, "up").otherwise("none").alias("tilt")).drop("_bd", "_bu")


def scorecard(picks: DataFrame) -> DataFrame:
    """Live record of the #1, the board's top 25 and all names.

    Runs that were late or not confirmed public are left out; halted and missing
    outcomes are counted apart and enter no rate.
    """
    counted = picks.filter(~F.col("late") & ~F.col("unverified"))
    graded = F.col("next_oc").isNotNull() & ~F.coalesce("halted", F.lit(False))
    held = in_subsets(counted, {"top": F.col("board_rank") == 1, "board": F.col("board_rank") <= 25, "universe": F.lit(True)}, "cohort")
    oc = F.when(graded, F.col("next_oc"))
    return held.groupBy("cohort").agg(
        F.countDistinct("session").alias("n_days"), F.count_if(graded).alias("n_graded"),
        F.count_if(F.col("next_oc").isNull()).alias("n_missing"), F.count_if(F.coalesce("halted", F.lit(False))).alias("n_halted"),
        rate(oc <= fixed.DUMP).alias("dump_rate"), F.avg(oc).alias("mean_oc"),
        rate(F.when(graded, F.col("next_oh")) >= fixed.SQUEEZE).alias("squeeze_rate"))


def subset_record(rows: DataFrame, subsets: Mapping[str, Column]) -> DataFrame:
    """The same record over overlapping subsets of the days."""
    return in_subsets(rows, subsets).groupBy("subset").agg(
        F.count("*").alias("n"), rate(F.col("next_oc") <= fixed.DUMP).alias("dump_rate"),
        rate(F.col("next_oc") <= fixed.FALL_3).alias("d3_rate"), F.avg("next_oc").alias("mean_oc"),
        rate(F.col("next_oc") >= fixed.UP_10).alias("up10"))


def dev_confirm(rows: DataFrame, key: str, cut: str, metrics: Mapping[str, Column]) -> DataFrame:
    """Every metric side by side before (`dev`) and from (`confirm`) the cut."""
    period = F.when(F.col("session") < F.lit(cut).cast("date"), "dev").otherwise("confirm")
    return rows.withColumn("period", period).groupBy(key).pivot("period", ["dev", "confirm"]).agg(
        *[m.alias(n) for n, m in metrics.items()])


def trade_sim(trades: DataFrame, by: Sequence[str] = (), oc: str = "next_oc", cost: str = "cost",
              stake: float = 0.1) -> DataFrame:
    """Net mean, win rate, worst trade and the multiple of risking `stake` of the account each day.

    A day that would lose the whole stake and more makes the multiple missing.
    """
    net = -F.col(oc) - F.col(cost)
    growth = F.when(1 + stake * net > 0, F.ln(1 + stake * net))
    return trades.filter(F.col(oc).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n_trades"), F.avg(net).alias("net_mean"), rate(net > 0).alias("win_rate"),
        F.avg(cost).alias("mean_cost"), F.min(net).alias("worst_trade"),
        F.when(F.count(growth) == F.count(net), F.exp(F.sum(growth))).alias("compounded"))


def every_nth(rows: DataFrame, n: int, order: str = "session") -> DataFrame:
    """Non-overlapping trades: one per n sessions. `rows` holds one row per session."""
    return rows.withColumn("_i", F.row_number().over(W.orderBy(order)) - 1).filter(F.col("_i") % n == 0).drop("_i")


def leg_returns(prices: DataFrame, legs: Mapping[str, tuple[str, str]], split: Column) -> DataFrame:
    """Short return per entry/exit leg, for all days and by where the price stood at the split."""
    one = [F.struct(F.lit(n).alias("leg"), (-(F.try_divide(F.col(b), F.col(a)) - 1)).alias("ret")) for n, (a, b) in legs.items()]
    long = in_subsets(prices.withColumn("_l", F.explode(F.array(*one))),
                      {"all": F.lit(True), "up": split > 0, "down": split <= 0}, "cond")
    return long.filter(F.col("_l.ret").isNotNull()).groupBy(F.col("_l.leg").alias("leg"), "cond").agg(
        F.avg("_l.ret").alias("mean"), rate(F.col("_l.ret") > 0).alias("win"), F.count("*").alias("n"))


#: Terms of the tail's sum at most; nodes of the quadrature (Gauss-Legendre) elsewhere, and its reach in standard deviations.
TAIL_TERMS, TAIL_NODES, TAIL_REACH = 64, 100, 12.0


def _tail_sum(k: Column, n: Column, p: Column) -> Column:
    """P(at most k hits in n) by the term recursion, in logs so that long records do not underflow; k + 1 terms."""
    first = n * F.ln(1 - p)
    start = F.struct(first.alias("t"), F.exp(first).alias("s"))

    def step(a, i):
        t = a["t"] + F.ln((n - i + 1) / i) + F.ln(F.try_divide(p, 1 - p))
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    steps = F.when(k.between(1, TAIL_TERMS), F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k < 0, 0.0).otherwise(F.aggregate(steps, start, step, lambda a: F.least(a["s"], F.lit(1.0))))


def _tail_integral(k: Column, n: Column, p: Column) -> Column:
    """The same as a ratio of integrals of u^k (1 - u)^(n - k - 1) from p to 1 and from 0 to 1, in a fixed number of nodes.

    The integrand is taken relative to its peak, through log1p of the distance from it, so nothing of size n is
    ever subtracted; beyond `TAIL_REACH` deviations it is below the last digit. For k and n - k - 1 of `TAIL_TERMS` or more.
    """
    nodes, node_weights = np.polynomial.legendre.leggauss(TAIL_NODES)
    both = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w")) for x, w in zip(nodes, node_weights)])
    peak = k / (n - 1)
    reach = TAIL_REACH * F.sqrt(peak * (1 - peak) / (n - 1))
    low, high = F.greatest(peak - reach, F.lit(0.0)), F.least(peak + reach, F.lit(1.0))

    def over(start: Column, end: Column) -> Column:
        half, middle = (end - start) / 2, (end + start) / 2

        def add(total, node):
            away = middle + half * node["x"] - peak
            return total + node["w"] * F.exp(k * F.log1p(away / peak) + (n - k - 1) * F.log1p(-away / (1 - peak)))

        return half * F.aggregate(both, F.lit(0.0), add)

    at = F.least(F.greatest(p, low), high)
    above, below = over(at, high), over(low, at)
    return above / (above + below)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(at most k hits in n), in work that does not grow with k or n.

    Few hits or few misses: the sum of their terms (of the misses, one minus it). Otherwise the incomplete beta ratio by quadrature.
    """
    from_misses = 1 - _tail_sum(n - k - 1, n, 1 - p)
    inside = F.when(k <= TAIL_TERMS, _tail_sum(k, n, p)).when(n - k - 1 <= TAIL_TERMS, from_misses).otherwise(_tail_integral(k, n, p))
    return F.when(k >= n, 1.0).when(p <= 0, 1.0).when(p >= 1, 0.0).otherwise(inside)


def tail_status(p_tail: Column, n: Column, min_days: int = 20, alpha: float = 0.05) -> Column:
    return F.when(n < min_days, "too few days").when(p_tail < alpha, "below").otherwise("consistent")


HLL_BITS = 12


def distinct_sketches(rows: DataFrame, by: str = "session", key: str = "symbol", bits: int = HLL_BITS) -> DataFrame:
    """A28, stored: rows and a sketch of the distinct keys per session. One scan; sketches of spans are unions of these."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.hll_sketch_agg(key, F.lit(bits)).alias("keys"))


def distinct_in_spans(sketches: DataFrame, spans: DataFrame, by: str = "session") -> DataFrame:
    """Distinct keys, sessions and rows of each span (id, start, end: both included), from the stored sketches alone.

    `spans` is a list of asked spans, `sketches` one row per session; the count of keys is estimated, with a relative
    standard error of `distinct_error`, and exact for the few hundred keys a sketch holds one by one.
    """
    met = sketches.join(F.broadcast(spans), (F.col(by) >= F.col("start")) & (F.col(by) <= F.col("end")))
    return met.groupBy("id", "start", "end").agg(
        F.hll_sketch_estimate(F.hll_union_agg("keys")).alias("n_symbols"), F.count("*").alias("n_days"), F.sum("n").alias("n_rows"))


def distinct_error(bits: int = HLL_BITS) -> float:
    """Relative standard error of an estimate beyond the keys held one by one."""
    return 0.8326 / 2 ** (bits / 2)


def t_statistic(rows: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mean over its standard error, and the number of independent trades."""
    n = F.count(value)
    return rows.groupBy(*by).agg(
        n.alias("indep"), F.avg(value).alias("mean"),
        F.try_divide(F.avg(value), F.stddev_samp(value) / F.sqrt(n)).alias("t"))


def survivorship(rows: DataFrame, liquid: Column, last: Column, horizon: int = 20) -> DataFrame:
    """The same long trade on today's list and on the list known at the time.

    `today` keeps the names that are liquid in the `last` session, in all sessions;
    `point in time` the names liquid in each session. The trade shorts each
    session's largest five-session riser; net pays its spread.
    """
    fwd = f"fwd{horizon}"
    survivor = F.bool_or(F.when(F.col("session") == last, liquid)).over(W.partitionBy("symbol"))
    held = rows.withColumn("_survivor", survivor).filter(F.col(fwd).isNotNull())
    held = in_subsets(held, {"today": F.col("_survivor"), "point in time": liquid}, "list")
    riser = F.struct(F.col("r5").isNull(), -F.col("r5"), F.col("symbol"))          # largest first, missing last
    days = held.groupBy("list", "session").agg(
        F.count("*").alias("_n"), F.sum(fwd).alias("_sum"), F.min_by(-F.col(fwd) - F.col("spread"), riser).alias("_net"))
    return days.groupBy("list").agg(
        F.sum("_n").alias("n"), (F.sum("_sum") / F.sum("_n")).alias("tier_mean"), F.avg("_net").alias("net"))
