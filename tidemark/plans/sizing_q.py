"""Cost, capacity and allocation (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, sizing
from ..operators import allocation
from . import board
from .ctes import LAW_K, LAW_S, r6
from .registry import query, r

_SIZES_SQL = "(SELECT unnest([" + ", ".join(f"{q}::DOUBLE" for q in fixed.SIZES) + "]) AS size)"
LAW_SQL = f"({LAW_S} + {LAW_K} * sqrt({{q}}))"


def sized(rows):
    """One row per name and position size."""
    return rows.withColumn("size", F.explode(F.array(*[F.lit(float(q)) for q in fixed.SIZES])))


@query("x1_cost_law", f"""
    SELECT session, symbol, size, {r6(LAW_SQL.format(q='size'), 'cost')} FROM picks, {_SIZES_SQL}""", "picks")
def x1(spark, d):
    return sized(board.picks(spark, d, places=())).select("session", "symbol", "size", r(sizing.cost_law("size", "c10", "spread"), "cost"))


@query("x2_cost_at", f"""
    SELECT session, symbol, {r6('coalesce(CASE WHEN symbol % 3 = 0 THEN 1.5 * c10 END, ' + LAW_SQL.format(q='30000::DOUBLE') + ')', 'cost_30k')},
      {r6(LAW_SQL.format(q='500000::DOUBLE'), 'cost_500k')} FROM picks""", "picks")
def x2(spark, d):
    published = F.when(F.col("symbol") % 3 == 0, F.create_map(F.lit("10000"), F.col("c10"), F.lit("30000"), 1.5 * F.col("c10"))
                       ).otherwise(F.create_map(F.lit("10000"), F.col("c10")))
    rows = board.picks(spark, d, places=()).withColumn("costs", published)
    return rows.select("session", "symbol", r(sizing.cost_at("costs", 30000, "c10", "spread"), "cost_30k"),
                       r(sizing.cost_at("costs", 500000, "c10", "spread"), "cost_500k"))


@query("x3_cost_model", f"""
    SELECT session, symbol, size, {r6('2 * 0.7::DOUBLE * vol20 * sqrt(size / nullif(exp_dvol, 0)) + spread', 'cost')},
      {r6('size / nullif(exp_dvol, 0)', 'participation')}, coalesce(size <= capacity, false) AS within_capacity,
      size <= breakeven AS below_breakeven FROM picks, {_SIZES_SQL}""", "picks")
def x3(spark, d):
    return sized(board.picks(spark, d, places=())).select(
        "session", "symbol", "size", r(sizing.impact_cost("size", "vol20", "exp_dvol", "spread"), "cost"),
        r(sizing.participation("size", "exp_dvol"), "participation"),
        F.coalesce(F.col("size") <= F.col("capacity"), F.lit(False)).alias("within_capacity"),
        (F.col("size") <= F.col("breakeven")).alias("below_breakeven"))


@query("x4_breakeven", f"SELECT session, symbol, {r6('ln(breakeven)', 'ln_breakeven')} FROM picks", "picks")
def x4(spark, d):
    return board.picks(spark, d, places=()).select("session", "symbol", r(F.ln("breakeven"), "ln_breakeven"))


_CAP_V, _CAP_I = "0.05::DOUBLE * exp_dvol", "exp_dvol * pow(0.005::DOUBLE / nullif(0.7::DOUBLE * vol20, 0), 2)"


@query("x5_capacity", f"""
    SELECT session, symbol, {r6('exp_dvol', places=2)}, {r6('capacity', places=2)},
      CASE WHEN capacity = {_CAP_V} THEN 'volume' WHEN capacity = {_CAP_I} THEN 'impact' WHEN capacity = cap_borrow THEN 'borrow' END AS limit_by
    FROM picks""", "picks")
def x5(spark, d):
    return board.picks(spark, d, places=()).select(
        "session", "symbol", r("exp_dvol", places=2), r("capacity", places=2),
        sizing.binding_limit("exp_dvol", "vol20", "cap_borrow").alias("limit_by"))


_GRID = f"""
    grid AS (SELECT p.session, total, k, symbol, pos, c10, spread, next_oc,
        CASE WHEN lim >= 1000 THEN lim ELSE 0 END AS cap, CASE WHEN coalesce(breakeven, 'Infinity'::DOUBLE) < capacity THEN 'breakeven' ELSE 'capacity' END AS why
      FROM (SELECT *, least(capacity, coalesce(breakeven, 'Infinity'::DOUBLE)) AS lim,
              row_number() OVER (PARTITION BY session ORDER BY rank) AS pos FROM board WHERE publishable AND capacity IS NOT NULL) p,
        (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in fixed.PLAN_TOTALS)}]) AS total),
        (SELECT unnest([{', '.join(map(str, fixed.PLAN_K))}]) AS k) WHERE pos <= k),
    filled AS (SELECT *, sum(cap) OVER w - cap AS before, row_number() OVER w AS i, count(*) OVER (PARTITION BY session, total, k) AS n
      FROM grid WHERE cap > 0 WINDOW w AS (PARTITION BY session, total, k ORDER BY cap, symbol)),
    levels AS (SELECT session, total, k, arg_min((total - before) / (n - i + 1), i) AS level FROM filled
      WHERE before + cap * (n - i + 1) >= total GROUP BY ALL),
    plan AS (SELECT g.*, least(cap, coalesce(level, 'Infinity'::DOUBLE)) AS alloc,
        greatest(total - sum(cap) OVER (PARTITION BY session, total, k), 0) AS left_over
      FROM grid g LEFT JOIN levels l USING (session, total, k)),
    priced AS (SELECT *, CASE WHEN alloc > 0 THEN {LAW_SQL.format(q='alloc')} END AS cost FROM plan)"""


@query("x6_waterfill", f"""
    WITH {_GRID} SELECT session, total, k, symbol, {r6('cap', places=4)}, {r6('alloc', places=4)}, {r6('left_over', places=4)} FROM plan""", "board")
def x6(spark, d):
    rows = allocation.waterfill(allocation.basket_rows(board.board(spark, d)), ["session", "total", "k"], ["symbol"],
                                small=True)
    return rows.select("session", "total", "k", "symbol", r("cap", places=4), r("alloc", places=4), r("left_over", places=4))


@query("x7_plan_basket", f"""
    WITH {_GRID} SELECT session, total, k, count(*) AS n_names, {r6('sum(alloc)', 'deployed', 4)}, {r6('max(left_over)', 'left_over', 4)},
      {r6('CASE WHEN sum(alloc) > 0 THEN sum(coalesce(alloc * cost, 0)) / sum(alloc) END', 'mean_cost')} FROM priced GROUP BY ALL""", "board")
def x7(spark, d):
    plan = allocation.plan_summary(allocation.plan_basket(board.board(spark, d)))
    return plan.select("session", "total", "k", "n_names", r("deployed", places=4), r("left_over", places=4), r("mean_cost"))


_SCENARIOS = {"as estimated": "spread", "half": "0.5 * spread", "one tick": "CASE WHEN close >= 1 THEN 0.01 / close ELSE 0.0001 / close END"}


@query("x8_spread_scenarios", " UNION ALL ".join(f"""
    SELECT '{n}' AS scenario, model_used, count(*) AS n, {r6('avg(c)', 'mean_cost')}, {r6('avg(-next_oc - c)', 'mean_net')}
    FROM (SELECT *, 2 * 0.7::DOUBLE * vol20 * sqrt(30000::DOUBLE / exp_dvol) + {e} AS c FROM board WHERE next_oc IS NOT NULL) GROUP BY model_used"""
    for n, e in _SCENARIOS.items()), "board")
def x8(spark, d):
    tick = F.when(F.col("close") >= 1, 0.01 / F.col("close")).otherwise(0.0001 / F.col("close"))
    spreads = {"as estimated": F.col("spread"), "half": 0.5 * F.col("spread"), "one tick": tick}
    rows = board.board(spark, d).filter(F.col("next_oc").isNotNull()).withColumn("s", F.explode(F.array(*[
        F.struct(F.lit(n).alias("scenario"), c.alias("spread")) for n, c in spreads.items()])))
    cost = sizing.impact_cost(F.lit(30000.0), "vol20", "exp_dvol", "s.spread")
    return rows.groupBy("s.scenario", "model_used").agg(
        F.count("*").alias("n"), r(F.avg(cost), "mean_cost"), r(F.avg(-F.col("next_oc") - cost), "mean_net"))
