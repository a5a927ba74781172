"""Per-symbol features over sessions, labels and model stand-in scores.

Bars hold one row per (symbol, session), so a symbol's window is as long as the
calendar, whatever the number of trades. Every feature ends at its own session;
every label starts at the next one. All of them share one exchange on `symbol`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import logistic

def by_symbol():
    return W.partitionBy("symbol").orderBy("session")


def calendar():
    """Over session-grain rows only: one row per session."""
    return W.orderBy("session")


def trailing(n: int, last: int = 0):
    """The n sessions that end `last` sessions from this one."""
    return by_symbol().rowsBetween(last - n + 1, last)


def full(agg: Column, counted: str, n: int, w) -> Column:
    """An aggregate over the n sessions of `w`, missing until all n are there."""
    return F.when(F.count(counted).over(w) == n, agg.over(w))


def spread_cap(dollar_volume: str) -> Column:
    cap = F.when(F.col(dollar_volume) < fixed.SPREAD_TIERS[0][0], fixed.SPREAD_TIERS[0][1])
    for top, limit in fixed.SPREAD_TIERS[1:]:
        cap = cap.when(F.col(dollar_volume) < top, limit)
    return F.when(F.col(dollar_volume).isNotNull(), cap.otherwise(fixed.SPREAD_TOP_TIER))


def session_features(bars: DataFrame, horizon: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """W1-W8, W14-W16 and the outcome labels, in one pass over the bars.

    Our choices where only the meaning is fixed: averages need all their
    sessions; `rsi14` is the simple-average (Cutler) form; the 52-week high uses
    the sessions there are, up to 252; the short-sale restriction follows the
    public rule (low at or below 90% of the previous close: that session and the
    next); the spread is the Abdi-Ranaldo estimate, each pair ending at this
    session, kept between one tick and the liquidity-tier cap. `horizon` adds
    `fwd<horizon>`: from the next open to the horizon-th close; `keep` names further
    columns of the bars to carry along.
    """
    w = by_symbol()
    longer = [(F.lead("close", horizon).over(w) / F.lead("open").over(w) - 1).alias(f"fwd{horizon}")] if horizon else []
    eta = (F.ln("high") + F.ln("low")) / 2
    lagged = bars.select(
        "*",
        F.lag("close").over(w).alias("prev_close"),
        F.lag("close", 3).over(w).alias("_c3"),
        F.lag("close", 5).over(w).alias("_c5"),
        F.lag("close", 20).over(w).alias("_c20"),
        F.lead("open").over(w).alias("next_open"),
        F.lead("close").over(w).alias("next_close"),
        F.lead("high").over(w).alias("next_high"),
        F.lead("low").over(w).alias("next_low"),
        F.lead("close", 5).over(w).alias("_close5"),
        eta.alias("_eta"),
        F.lag(F.ln("close")).over(w).alias("_lc1"),
        F.lag(eta).over(w).alias("_eta1"),
        *longer,
    )
    moved = lagged.select(
        "*",
        (F.col("close") / F.col("prev_close") - 1).alias("r1"),
        (F.col("close") / F.col("_c3") - 1).alias("r3"),
        (F.col("close") / F.col("_c5") - 1).alias("r5"),
        (F.col("close") / F.col("_c20") - 1).alias("r20"),
        F.when(F.col("prev_close").isNotNull(), F.greatest(F.col("close") - F.col("prev_close"), F.lit(0.0))).alias("_gain"),
        F.when(F.col("prev_close").isNotNull(), F.greatest(F.col("prev_close") - F.col("close"), F.lit(0.0))).alias("_loss"),
        (F.col("close") * F.col("volume")).alias("_dollars"),
        (4 * (F.col("_lc1") - F.col("_eta1")) * (F.col("_lc1") - F.col("_eta"))).alias("_s2"),
        (F.col("low") <= 0.9 * F.col("prev_close")).alias("ssr_trigger"),
    )
    w5, w14, w20, w50, prior20 = trailing(5), trailing(14), trailing(20), trailing(50), trailing(20, -1)
    gain, loss = full(F.avg("_gain"), "_gain", 14, w14), full(F.avg("_loss"), "_loss", 14, w14)
    framed = moved.select(
        "symbol", "session", "open", "high", "low", "close", "volume", "short_volume", "short_interest",
        "prev_close", "next_open", "r1", "r3", "r5", "r20", "ssr_trigger",
        F.try_divide(F.col("volume"), full(F.avg("volume"), "volume", 20, prior20)).alias("rvol1"),
        F.try_divide(100 * gain, gain + loss).alias("rsi14"),
        (F.col("close") / full(F.avg("close"), "close", 20, w20) - 1).alias("dist_ma20"),
        (F.col("close") / full(F.avg("close"), "close", 50, w50) - 1).alias("dist_ma50"),
        (F.col("close") / F.max("high").over(trailing(252)) - 1).alias("dd_52w"),
        full(F.stddev_samp("r1"), "r1", 20, w20).alias("vol20"),
        full(F.avg("_dollars"), "_dollars", 20, w20).alias("dvol20"),
        full(F.avg("_dollars"), "_dollars", 5, w5).alias("dvol5"),
        F.try_divide(full(F.sum("short_volume"), "volume", 5, w5), full(F.sum("volume"), "volume", 5, w5)).alias("short_ratio_5d"),
        F.try_divide(F.col("short_interest"), full(F.avg("volume"), "volume", 20, w20)).alias("days_to_cover"),
        full(F.avg("_s2"), "_s2", 20, w20).alias("_s2mean"),
        (F.col("ssr_trigger") | F.coalesce(F.lag("ssr_trigger").over(w), F.lit(False))).alias("ssr"),
        (F.col("close") / F.col("open") - 1).alias("oc"),
        (F.col("high") / F.col("open") - 1).alias("oh"),
        (F.col("low") / F.col("open") - 1).alias("ol"),
        (F.col("open") / F.col("prev_close") - 1).alias("gap_pct"),
        (F.col("next_close") / F.col("next_open") - 1).alias("next_oc"),
        (F.col("next_high") / F.col("next_open") - 1).alias("next_oh"),
        (F.col("next_low") / F.col("next_open") - 1).alias("next_ol"),
        (F.col("_close5") / F.col("next_open") - 1).alias("swing5"),
        *([f"fwd{horizon}"] if horizon else []), *keep,
    )
    cap = spread_cap("dvol20")
    tick = F.when(F.col("close") >= 1, 0.01 / F.col("close")).otherwise(0.0001 / F.col("close"))
    estimate = F.least(F.greatest(F.sqrt("_s2mean"), tick), cap)
    return framed.select(
        "*",
        F.when(F.col("_s2mean") > 0, estimate).when(F.col("_s2mean").isNotNull(), cap).alias("spread"),
        F.when(F.col("_s2mean") > 0, "estimate").when(F.col("_s2mean").isNotNull(), "band cap").alias("spread_source"),
    ).drop("_s2mean")


def stand_in_scores(panel: DataFrame) -> DataFrame:
    """Fixed logistic readings of the features, used where no fitted model is asked for.

    Rounded to nine places so that equal inputs give equal ranks on any engine.
    """
    p1 = F.round(logistic(10 * F.col("vol20") - 2), 9)
    p2 = F.round(logistic(-5 * F.col("r1")), 9)
    p3 = F.round(logistic(-5 * F.col("dist_ma20")), 9)
    known = F.col("vol20").isNotNull() & F.col("dist_ma20").isNotNull() & F.col("r1").isNotNull()
    return panel.filter(known).select(
        "*",
        p1.alias("prob_dump"), p2.alias("one_dump"), p3.alias("one_d3"),
        F.round(1 - p2, 9).alias("prob_pump"),
        F.round(logistic(8 * F.col("vol20") - 3), 9).alias("prob_squeeze"),
        p3.alias("prob_swing"),
        F.round(logistic(8 * F.col("vol20") - 4), 9).alias("prob_bigdump"),
        F.round(p3 - 0.5, 9).alias("liq_edge"),
        F.when(F.col("symbol") % 2 == 0, "m1").otherwise("m0").alias("model_used"),
    )


def series_change(bars: DataFrame) -> DataFrame:
    """First and last close of each symbol and the change between them (two closes at least)."""
    out = bars.filter(F.col("close").isNotNull()).groupBy("symbol").agg(
        F.min_by("close", "session").alias("first_close"), F.max_by("close", "session").alias("last_close"),
        F.count("*").alias("n"))
    return out.withColumn("change", F.when(F.col("n") >= 2, F.col("last_close") / F.col("first_close") - 1))


def window_extremes(bars: DataFrame) -> DataFrame:
    """High and low close with the 0-based position of their first occurrence.

    Positive closes only; symbols with fewer than four are left out.
    """
    placed = bars.withColumn("i", F.row_number().over(by_symbol()).cast("bigint") - 1).filter(F.col("close") > 0)
    return placed.groupBy("symbol").agg(
        F.max("close").alias("hi"), F.min_by("i", F.struct(-F.col("close"), F.col("session"))).alias("hi_index"),
        F.min("close").alias("lo"), F.min_by("i", F.struct("close", "session")).alias("lo_index"),
        F.count("*").alias("_n"),
    ).filter(F.col("_n") >= 4).drop("_n")


# ── session-grain series: one row per session of the calendar ───────────────

def regime_percentile(rows: DataFrame, look_back: int = 252) -> DataFrame:
    """Session mean odds and their percentile among the previous `look_back` sessions."""
    by_session = rows.groupBy("session").agg(F.avg("prob_dump").alias("mean_odds"))
    prior = F.collect_list(F.round("mean_odds", 12)).over(calendar().rowsBetween(-look_back, -1))
    x = F.round("mean_odds", 12)
    at_or_below = F.size(F.filter("_prior", lambda v: v <= x))
    return by_session.withColumn("_prior", prior).select(
        "session", "mean_odds", F.size("_prior").cast("bigint").alias("n_prior"),
        F.when(F.size("_prior") > 0, 100.0 * at_or_below / F.nullif(F.size("_prior"), F.lit(0))).alias("regime_pct"))


def realised_rate(rows: DataFrame, n: int) -> DataFrame:
    """Share of all names that dumped over the last n sessions."""
    by_session = rows.groupBy("session").agg(F.count_if(F.col("oc") <= -0.05).alias("_d"), F.count("*").alias("_n"))
    w = calendar().rowsBetween(1 - n, 0)
    return by_session.select("session", (F.sum("_d").over(w) / F.sum("_n").over(w)).alias(f"dump_rate_{n}d"))


def benchmark_tape(bars: DataFrame) -> DataFrame:
    """Mean close of all names per session and its one-session return."""
    level = bars.groupBy("session").agg(F.avg("close").alias("level"))
    return level.withColumn("bench_r1", F.col("level") / F.lag("level").over(calendar()) - 1)


def prior_state(panel: DataFrame, tape: DataFrame) -> DataFrame:
    """Each name's last return beside the benchmark's. The tape has one row per session."""
    return panel.join(F.broadcast(tape.select("session", "bench_r1")), "session").select(
        *panel.columns, "bench_r1", (F.col("r1") < 0).alias("fell"), (F.col("bench_r1") <= -0.01).alias("weak_tape"),
        F.coalesce(F.col("bench_r1") < 0, F.lit(False)).alias("down_night"))


def family_scores(rows: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """0-100 per signal family: mean session percentile of its inputs (our formula); missing when all are."""
    from .ranking import with_percent_rank
    cols = [c for cs in families.values() for c in cs]
    placed = with_percent_rank(rows.select("session", "symbol", *cols), "session", "symbol", cols)

    def mean_known(cols: list[str]) -> Column:
        prs = [F.col(f"{c}_pr") for c in cols]
        n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in prs), F.lit(0))
        return F.try_divide(100 * sum((F.coalesce(p, F.lit(0.0)) for p in prs), F.lit(0.0)), n)

    return placed.select("session", "symbol", *[mean_known(cs).alias(f) for f, cs in families.items()])


def recent_history(rows: DataFrame, value: str, n: int) -> DataFrame:
    """Last n sessions of a value per symbol: ordered series, first and last."""
    w = W.partitionBy("symbol").orderBy(F.col("session").desc())
    kept = rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n)
    return kept.groupBy("symbol").agg(
        F.count("*").alias("n"),
        F.min_by(value, "session").alias("first"), F.max_by(value, "session").alias("last"),
        F.array_sort(F.collect_list(F.struct("session", F.col(value).alias("value")))).alias("series"))
