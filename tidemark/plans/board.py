"""The scored universe and the board, one row per (session, symbol)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, predicates, sizing
from ..functions.scalars import ratio
from ..operators.features import benchmark_tape, session_features, stand_in_scores
from ..operators.ranking import beside, percent_ranks, ranks_desc, row_numbers, top_k, with_row_number
from ..session import cut
from ..sources import derived

AVG_MOVE = 0.08          # average move of a pick that breakeven sizes are solved against
PLACES = ("lift", "danger", "urank", "board")          # columns of a pick that depend on its whole session
DANGER_PARTS = ["model", "fee", "scarcity", "si", "dtc", "float", "short_vol"]
DANGER_INPUTS = ["prob_squeeze", "fee_rate", "available", "si_pct_float", "days_to_cover", "shares_out", "short_ratio_5d"]


def panel(spark: SparkSession, d: str, grain: str = "month") -> DataFrame:
    return session_features(derived.bars(spark, d, grain))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return stand_in_scores(panel(spark, d))


def supply_by_session(filings: DataFrame) -> DataFrame:
    publish = F.to_timestamp(F.last_day("session")) + F.expr("INTERVAL 12 HOURS")
    return filings.groupBy("symbol", "session").agg(
        F.bool_or(predicates.fresh_supply("category", "accepted", "day", publish)).alias("fresh_supply"),
        F.bool_or(F.col("category") == "offering").alias("offered"),
        F.bool_or(F.col("category") == "atm").alias("has_atm"))


def wide(spark: SparkSession, d: str, facts: DataFrame | None = None) -> DataFrame:
    """Scored rows with names, borrow, supply filings and cost inputs, from the session facts (of the trades, if none are given)."""
    facts = derived.session_facts(spark, d) if facts is None else facts
    extra = ["borrow_asof", "status", "fee_rate", "available", "fresh_supply", "offered", "has_atm"]
    joined = stand_in_scores(session_features(facts, keep=extra)).join(derived.names(spark, d), "symbol")
    volume = sizing.expected_volume("dvol20", "dvol5")
    return joined.select(
        *joined.columns,
        (F.col("close") / 100).alias("price"),
        (F.col("available") * F.col("close")).alias("cap_borrow"),
        (F.col("short_interest") / F.col("shares_out")).alias("si_pct_float"),
        volume.alias("exp_dvol"),
        sizing.impact_cost(F.lit(10000.0), "vol20", volume, "spread").alias("c10"),
        F.col("ssr_trigger").alias("ssr_next"),
    )


def with_squeeze_danger(df: DataFrame) -> DataFrame:
    """0-100 crowding score: mean session percentile of up to seven parts (our formula).

    Missing where fewer than three parts are known. `df` is read three times: hand in written rows.
    """
    parts = df.select(
        "session", "symbol", F.col("prob_squeeze").alias("model"), F.col("fee_rate").alias("fee"), (-F.col("available")).alias("scarcity"),
        F.col("si_pct_float").alias("si"), F.col("days_to_cover").alias("dtc"), (-F.col("shares_out")).alias("float"),
        F.col("short_ratio_5d").alias("short_vol"))
    placed = beside(df, percent_ranks(parts, "session", "symbol", DANGER_PARTS, "_pr"), ["session", "symbol"], "left")
    prs = [F.col(f"{p}_pr") for p in DANGER_PARTS]
    n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in prs), F.lit(0))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in prs), F.lit(0.0))
    return placed.select(
        *df.columns, *[F.col(f"{p}_pr").alias(f"pr_{p}") for p in DANGER_PARTS],
        F.when(n >= 3, F.round(100 * (total / n), 6)).alias("squeeze_danger"))


def danger(spark: SparkSession, d: str) -> DataFrame:
    """Every name of every session with its crowding score."""
    return with_squeeze_danger(cut(wide(spark, d).select("session", "symbol", "prob_dump", *DANGER_INPUTS)))


def with_base(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """Add the share of the session's `scored` names that dumped."""
    dumped = F.when(F.col("oc") <= fixed.DUMP, 1.0).otherwise(0.0)
    base = scored.groupBy("session").agg(F.avg(dumped).alias("base"))
    return beside(rows, F.broadcast(base), ["session"])          # one row per session of the calendar


def flag_list() -> Column:
    """Flags of a pick as an array. Joined and split again: unlike a lambda this stays in generated code."""
    joined = F.concat_ws(
        "|", F.when(F.col("offered"), "OFFERING 24H"), F.when(F.col("has_atm"), "ATM"),
        F.when(F.col("gap_pct") >= 0.1, "GAP UP"), F.when(F.col("r3") >= 0.3, "RUN 3D"),
        F.when(F.col("status") == "NONE", "NO BORROW"), F.when(F.col("high") == F.col("low"), "HALTED"),
        F.when(F.col("country") == "Singapore", "ASIA"), F.when(F.col("dd_52w") <= -0.2, "DRAWDOWN"))
    return F.when(joined != "", F.split(joined, "\\|")).otherwise(F.array().cast("array<string>"))


#: Inputs of the reasons to hold a name off, beside the crowding score.
ZONE_INPUTS = ["status", "high", "low", "cap_borrow"]


def picks(spark: SparkSession, d: str, facts: DataFrame | None = None, places: Sequence[str] = PLACES,
          keep: Sequence[str] | None = None) -> DataFrame:
    """Every scored name of every session with its gates, sizes, ranks and next-session outcome.

    `places` says which of the columns that depend on the whole session are wanted: `lift`, `danger` (pr_*,
    squeeze_danger and the zone it decides), `urank` and `board` (board_rank, with those of `danger`); the others are
    left out. They come from value counts, sorts by range and first hundreds of the written rows, so no task holds a session.
    `keep` names the columns that are returned beside the key (all, if none are named). The rows are written with these and the
    inputs of `places` alone, so windows behind other columns are never computed.
    """
    rows = wide(spark, d, facts)
    rows = rows.select(
        "*",
        sizing.capacity("exp_dvol", "vol20", "cap_borrow").alias("capacity"),
        sizing.breakeven(F.lit(AVG_MOVE), "c10", "spread").alias("breakeven"),
        predicates.publishable().alias("publishable"),
        flag_list().alias("flags"),
    )
    on, placed = ["session", "symbol"], {"danger", "board"} & set(places)
    if keep is not None:
        inputs = {*on, *keep, *(("prob_dump",) if places else ()), *(("oc",) if "lift" in places else ()),
                  *((*DANGER_INPUTS, *ZONE_INPUTS) if placed else ())}
        rows = rows.select(*[c for c in rows.columns if c in inputs])
    if not places:
        return rows
    rows = cut(rows)
    out = rows
    if placed:
        scores = with_squeeze_danger(rows.select(*on, *DANGER_INPUTS)).drop(*DANGER_INPUTS)
        out = beside(rows, scores, on).withColumn("zone_reason", predicates.zone_reason())
        if keep is not None:
            out = out.select(*[c for c in out.columns if c in (*on, *keep, "prob_dump", "zone_reason")])
        # the board's first hundreds and the rows both read the scores
        out = cut(out) if "board" in places else out
    if "lift" in places:
        out = with_base(out, rows).withColumn("lift", ratio("prob_dump", "base")).drop("base")
    if "urank" in places:
        out = beside(out, row_numbers(rows, "session", "symbol", {"urank": F.col("prob_dump")}), on)
    if "board" in places:
        best = [F.col("prob_dump").desc(), F.col("symbol")]
        first = top_k(out.filter(F.col("zone_reason").isNull()).select(*on, "prob_dump"), "session", best, 100, "board_rank")
        out = beside(out, F.broadcast(first.select(*on, "board_rank")), on, "left")       # a hundred rows a session of the calendar
    return out if keep is None else out.select(*[c for c in out.columns if c in (*on, *keep)])


def board(spark: SparkSession, d: str, places: Sequence[str] = PLACES, keep: Sequence[str] | None = None) -> DataFrame:
    """At most 100 names per session; `places` and `keep` as in `picks`."""
    keep = None if keep is None else [*keep, "board_rank"]
    shown = picks(spark, d, places=[*places, "board"], keep=keep).filter(F.col("board_rank").isNotNull())
    return shown.withColumn("rank", F.col("board_rank"))


def first_choices(spark: SparkSession, d: str) -> DataFrame:
    """The consensus #1 of each session beside the benchmark's move; the trades are scanned once for both."""
    facts = cut(derived.session_facts(spark, d))
    one = consensus(cut(picks(spark, d, facts, places=()))).filter(F.col("consensus_rank") == 1)
    return one.join(F.broadcast(benchmark_tape(facts)), "session")           # one row per session


def consensus(rows: DataFrame, size: float = fixed.BOARD_MIN_USD) -> DataFrame:
    """Sum of three models' rank shortfalls over the tradable names, and its tier (our formula).

    deficit = (rank - 1) summed over the models; high <= 2, medium <= 7, else low.
    Names that cannot take `size` stay in the rows with these columns missing. `rows` is read often: hand in written rows.
    """
    able = (sizing.volume_cap("exp_dvol") >= size) & (sizing.impact_cap("exp_dvol", "vol20") >= size)
    models, on = {"prob_dump": "rank_dump", "one_dump": "rank_one", "one_d3": "rank_d3"}, ["session", "symbol"]
    able = rows.filter(able).select(*on, *models)
    ranked = beside(able, ranks_desc(able, "session", "symbol", list(models), "_rk"), on, "left")
    ranked = ranked.select(*on, "prob_dump", *[F.col(f"{m}_rk").alias(n) for m, n in models.items()])
    ranked = ranked.withColumn("deficit", F.col("rank_dump") + F.col("rank_one") + F.col("rank_d3") - 3)
    order = [F.col("deficit").asc_nulls_last(), F.col("prob_dump").desc(), F.col("symbol")]
    ranked = with_row_number(ranked, "session", order, "_place")
    known = F.col("deficit").isNotNull()
    ranked = ranked.select(
        *on, *models.values(), "deficit", F.when(known, F.col("_place")).alias("consensus_rank"),
        F.when(F.col("deficit") <= 2, "high").when(F.col("deficit") <= 7, "medium").when(known, "low").alias("tier"))
    return beside(rows, ranked, on, "left")
