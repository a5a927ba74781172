"""SQL twins of the derived inputs, shared by the oracles: name -> (needs, sql)."""

from __future__ import annotations

from ..functions import fixed


def r6(expr: str, name: str | None = None, places: int = 6) -> str:
    """Rounded output column (no negative zero)."""
    return f"(round({expr}, {places}) + 0.0::DOUBLE) AS {name or expr}"


def sigma(expr: str) -> str:
    return f"round(1 / (1 + exp(-({expr}))), 9)"


def pick(values, index: str) -> str:
    return f"(ARRAY[{', '.join(repr(v) for v in values)}])[CAST({index} AS INT) + 1]"


COUNTRIES = ["China", "Hong Kong", "United States", "Israel", "Singapore", "Canada", "Cayman Islands", "Germany"]
CATEGORIES = ["other", "offering", "atm", "registration", "reverse_split"]
STATUSES = ["ETB", "HTB", "NONE", "UNKNOWN"]

PRICE = "100 * (1 - l_discount) * (1 + l_tax) * (0.9 + l_quantity / 250)"
SEQ = ("(l_orderkey * 8 + l_linenumber) * 16384 + CAST(l_quantity AS BIGINT) * 256 + "
       "CAST(round(l_discount * 100) AS BIGINT) * 16 + CAST(round(l_tax * 100) AS BIGINT)")
ORD = "day, seq"


def bars_sql(grain: str) -> str:
    return f"""
    SELECT symbol, CAST(date_trunc('{grain}', day) AS DATE) AS session,
      first(price ORDER BY {ORD}) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY {ORD}) AS close,
      sum(qty) * 1000 AS volume,
      sum(CASE WHEN linestatus = 'F' THEN qty ELSE 0 END) * 1000 AS short_volume,
      sum(CASE WHEN returnflag = 'R' THEN qty ELSE 0 END) * 1000 AS short_interest
    FROM trades GROUP BY 1, 2"""


def rows(n: int, last: int = 0) -> str:
    start = f"{n - 1 - last} PRECEDING"
    end = "CURRENT ROW" if last == 0 else f"{-last} PRECEDING"
    return f"(PARTITION BY symbol ORDER BY session ROWS BETWEEN {start} AND {end})"


def full(agg: str, counted: str, n: int, last: int = 0) -> str:
    w = rows(n, last)
    return f"CASE WHEN count({counted}) OVER {w} = {n} THEN {agg} OVER {w} END"


def lagged_sql(source: str) -> str:
    return f"""
    SELECT *, lag(close) OVER w AS prev_close, lag(close, 3) OVER w AS c3, lag(close, 5) OVER w AS c5,
      lag(close, 20) OVER w AS c20, lead(open) OVER w AS next_open, lead(close) OVER w AS next_close,
      lead(high) OVER w AS next_high, lead(low) OVER w AS next_low, lead(close, 5) OVER w AS close5,
      (ln(high) + ln(low)) / 2 AS eta, lag(ln(close)) OVER w AS lc1, lag((ln(high) + ln(low)) / 2) OVER w AS eta1
    FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY session)"""


MOVED = """
    SELECT *, close / prev_close - 1 AS r1, close / c3 - 1 AS r3, close / c5 - 1 AS r5, close / c20 - 1 AS r20,
      CASE WHEN prev_close IS NOT NULL THEN greatest(close - prev_close, 0) END AS gain,
      CASE WHEN prev_close IS NOT NULL THEN greatest(prev_close - close, 0) END AS loss,
      close * volume AS dollars, 4 * (lc1 - eta1) * (lc1 - eta) AS s2, low <= 0.9::DOUBLE * prev_close AS ssr_trigger
    FROM {lagged}"""


def panel_sql(moved: str) -> str:
    tiers = " ".join(f"WHEN dvol20 < {t} THEN {c}" for t, c in fixed.SPREAD_TIERS)
    cap = f"CASE WHEN dvol20 IS NOT NULL THEN CASE {tiers} ELSE {fixed.SPREAD_TOP_TIER} END END"
    tick = "CASE WHEN close >= 1 THEN 0.01 / close ELSE 0.0001 / close END"
    return f"""
    SELECT * EXCLUDE (s2mean),
      CAST(CASE WHEN s2mean > 0 THEN least(greatest(sqrt(s2mean), {tick}), {cap})
           WHEN s2mean IS NOT NULL THEN {cap} END AS DOUBLE) AS spread,
      CASE WHEN s2mean > 0 THEN 'estimate' WHEN s2mean IS NOT NULL THEN 'band cap' END AS spread_source
    FROM (
      SELECT symbol, session, open, high, low, close, volume, short_volume, short_interest, prev_close,
        r1, r3, r5, r20, ssr_trigger,
        volume / nullif({full('avg(volume)', 'volume', 20, -1)}, 0) AS rvol1,
        100 * ({full('avg(gain)', 'gain', 14)}) /
          nullif(({full('avg(gain)', 'gain', 14)}) + ({full('avg(loss)', 'loss', 14)}), 0) AS rsi14,
        close / ({full('avg(close)', 'close', 20)}) - 1 AS dist_ma20,
        close / ({full('avg(close)', 'close', 50)}) - 1 AS dist_ma50,
        close / max(high) OVER {rows(252)} - 1 AS dd_52w,
        {full('stddev_samp(r1)', 'r1', 20)} AS vol20,
        {full('avg(dollars)', 'dollars', 20)} AS dvol20,
        {full('avg(dollars)', 'dollars', 5)} AS dvol5,
        ({full('sum(short_volume)', 'volume', 5)}) / nullif({full('sum(volume)', 'volume', 5)}, 0) AS short_ratio_5d,
        short_interest / nullif({full('avg(volume)', 'volume', 20)}, 0) AS days_to_cover,
        {full('avg(s2)', 's2', 20)} AS s2mean,
        ssr_trigger OR coalesce(lag(ssr_trigger) OVER w, false) AS ssr,
        close / open - 1 AS oc, high / open - 1 AS oh, low / open - 1 AS ol, open / prev_close - 1 AS gap_pct,
        next_close / next_open - 1 AS next_oc, next_high / next_open - 1 AS next_oh,
        next_low / next_open - 1 AS next_ol, close5 / next_open - 1 AS swing5
      FROM {moved} WINDOW w AS (PARTITION BY symbol ORDER BY session))"""


def _pr(c: str, src: str) -> str:
    n = f"count({src}) OVER (PARTITION BY session)"
    return (f"CASE WHEN {src} IS NOT NULL THEN CASE WHEN {n} > 1 THEN "
            f"(rank() OVER (PARTITION BY session ORDER BY {src} ASC NULLS LAST) - 1) / ({n} - 1)::DOUBLE "
            f"ELSE 0.0 END END AS {c}")


DANGER_PARTS = {
    "model": "prob_squeeze", "fee": "fee_rate", "scarcity": "-available", "si": "si_pct_float",
    "dtc": "days_to_cover", "float": "-shares_out", "short_vol": "short_ratio_5d",
}
_part_names = [f"pr_{p}" for p in DANGER_PARTS]
_part_sum = " + ".join(f"coalesce({p}, 0)" for p in _part_names)
_part_n = " + ".join(f"(CASE WHEN {p} IS NOT NULL THEN 1 ELSE 0 END)" for p in _part_names)

LAW_S = "greatest(spread, 0.001::DOUBLE)"
LAW_K = f"(greatest(c10 - {LAW_S}, 0) / 100.0)"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "trades": ((), f"""
        SELECT *, CAST(l_shipdate AS DATE) AS day, l_suppkey AS symbol, {PRICE} AS price, {SEQ} AS seq, l_quantity AS qty, l_tax AS tax,
          l_linenumber AS line, l_returnflag AS returnflag, l_linestatus AS linestatus, l_orderkey AS orderkey
        FROM lineitem"""),
    "bars": (("trades",), bars_sql("month")),
    "bars_w": (("trades",), bars_sql("week")),
    "ticks": ((), """
        SELECT event_id, user_id AS symbol, ts, value AS price,
          CAST(json_extract_string(props, '$.k') AS BIGINT) AS size, event_type FROM events"""),
    "bars_d": (("ticks",), """
        SELECT symbol, CAST(ts AS DATE) AS session, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
          arg_max(price, ts) AS close, CAST(sum(size) AS BIGINT) AS volume FROM ticks GROUP BY 1, 2"""),
    "quotes": (("ticks",), """
        SELECT *, price * (1 - size / 10000) AS bid, price * (1 + size / 10000) AS ask FROM ticks"""),
    "names": ((), f"""
        SELECT s_suppkey AS symbol, s_name AS name, {pick(COUNTRIES, 'n_nationkey % 8')} AS country, r_name AS sector,
          s_acctbal * 10000 AS market_cap, (1000 + abs(s_acctbal)) * 1000 AS shares_out
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "borrow": (("trades",), f"""
        SELECT symbol, day, status, CASE WHEN status <> 'UNKNOWN' THEN fee END AS fee_rate,
          CASE WHEN status = 'NONE' THEN 0.0::DOUBLE WHEN status <> 'UNKNOWN' THEN avail END AS available
        FROM (SELECT symbol, day, {pick(STATUSES, 'symbol % 4')} AS status, round(avg(tax) * 100, 9) AS fee,
                greatest(sum(qty) - 10, 0) * 1000 AS avail
              FROM trades GROUP BY symbol, day)"""),
    "filings": (("trades",), f"""
        SELECT symbol, day, orderkey, line, qty, {pick(CATEGORIES, 'line % 5')} AS category,
          CASE WHEN line % 2 = 0 THEN CAST(day AS TIMESTAMP) + line * 3 * INTERVAL 1 HOUR END AS accepted,
          CAST(date_trunc('month', day) AS DATE) AS session
        FROM trades WHERE returnflag = 'R'"""),
    "insider": (("trades",), """
        SELECT *, CASE returnflag WHEN 'A' THEN 'P' WHEN 'N' THEN 'S' ELSE '144' END AS code, qty AS shares FROM trades"""),
    "earnings": ((), """
        SELECT o_orderkey AS report_id, o_custkey % (SELECT count(*) FROM supplier) AS symbol,
          CAST(o_orderdate AS DATE) AS date,
          CASE left(o_orderpriority, 1) WHEN '1' THEN 'time-pre-market' WHEN '2' THEN 'time-after-hours'
            WHEN '3' THEN 'time-not-supplied' WHEN '4' THEN 'during_market' END AS time
        FROM orders"""),
    "chatter": (("ticks",), """
        SELECT symbol, ts, CASE event_type WHEN 'purchase' THEN 'bull' WHEN 'error' THEN 'bear' END AS tag FROM ticks"""),
    "lagged": (("bars",), lagged_sql("bars")),
    "moved": (("lagged",), MOVED.format(lagged="lagged")),
    "panel": (("moved",), panel_sql("moved")),
    "lagged_w": (("bars_w",), lagged_sql("bars_w")),
    "moved_w": (("lagged_w",), MOVED.format(lagged="lagged_w")),
    "panel_w": (("moved_w",), panel_sql("moved_w")),
    "scored": (("panel",), f"""
        SELECT *, {sigma('10 * vol20 - 2')} AS prob_dump, {sigma('-5 * r1')} AS one_dump, {sigma('-5 * dist_ma20')} AS one_d3,
          round(1 - {sigma('-5 * r1')}, 9) AS prob_pump, {sigma('8 * vol20 - 3')} AS prob_squeeze,
          {sigma('-5 * dist_ma20')} AS prob_swing, {sigma('8 * vol20 - 4')} AS prob_bigdump,
          round({sigma('-5 * dist_ma20')} - 0.5, 9) AS liq_edge,
          CASE WHEN symbol % 2 = 0 THEN 'm1' ELSE 'm0' END AS model_used
        FROM panel WHERE vol20 IS NOT NULL AND dist_ma20 IS NOT NULL AND r1 IS NOT NULL"""),
    "borrow_m": (("borrow",), """
        SELECT symbol, CAST(date_trunc('month', day) AS DATE) AS session, max(day) AS borrow_asof, first(status) AS status,
          arg_max(fee_rate, day) AS fee_rate, arg_max(available, day) AS available
        FROM borrow GROUP BY 1, 2"""),
    "supply_m": (("filings",), """
        SELECT symbol, session,
          bool_or(category IN ('offering', 'atm', 'toxic_financing', 'unregistered_sale') AND
            CASE WHEN accepted IS NOT NULL THEN accepted >= publish - INTERVAL 24 HOUR AND accepted <= publish + INTERVAL 1 HOUR
            ELSE day >= CAST(timezone('America/New_York', timezone('UTC', publish - INTERVAL 24 HOUR)) AS DATE) END) AS fresh_supply,
          bool_or(category = 'offering') AS offered, bool_or(category = 'atm') AS has_atm
        FROM (SELECT *, CAST(last_day(day) AS TIMESTAMP) + INTERVAL 12 HOUR AS publish FROM filings) GROUP BY 1, 2"""),
    "wide": (("scored", "names", "borrow_m", "supply_m"), """
        SELECT s.*, n.name, n.country, n.sector, n.market_cap, n.shares_out, s.close / 100 AS price,
          b.borrow_asof, b.status, b.fee_rate, b.available, b.available * s.close AS cap_borrow,
          s.short_interest / n.shares_out AS si_pct_float,
          least(dvol20, dvol5) AS exp_dvol,
          2 * 0.7::DOUBLE * vol20 * sqrt(10000::DOUBLE / least(dvol20, dvol5)) + spread AS c10,
          coalesce(f.fresh_supply, false) AS fresh_supply, coalesce(f.offered, false) AS offered,
          coalesce(f.has_atm, false) AS has_atm,
          s.ssr_trigger AS ssr_next
        FROM scored s JOIN names n USING (symbol) JOIN borrow_m b ON b.symbol = s.symbol AND b.session = s.session
          LEFT JOIN supply_m f ON f.symbol = s.symbol AND f.session = s.session"""),
    "danger": (("wide",), f"""
        SELECT *, CASE WHEN n_parts >= 3 THEN round(100 * (({_part_sum}) / n_parts), 6) END AS squeeze_danger
        FROM (SELECT *, {_part_n} AS n_parts
              FROM (SELECT *, {', '.join(_pr(f'pr_{p}', src) for p, src in DANGER_PARTS.items())} FROM wide))"""),
    "picks": (("danger",), f"""
        SELECT *, CASE WHEN rank0 <= 100 THEN rank0 END AS board_rank FROM (
        SELECT *,
          row_number() OVER (PARTITION BY session ORDER BY prob_dump DESC, symbol) AS urank,
          CASE WHEN zone_reason IS NULL THEN
            row_number() OVER (PARTITION BY session ORDER BY (zone_reason IS NULL) DESC, prob_dump DESC, symbol) END AS rank0
        FROM (
          SELECT d.*, prob_dump / nullif(base, 0) AS lift,
            least(0.05::DOUBLE * exp_dvol, exp_dvol * pow(0.005::DOUBLE / nullif(0.7::DOUBLE * vol20, 0), 2), cap_borrow) AS capacity,
            CASE WHEN 0.08::DOUBLE > {LAW_S} THEN pow((0.08::DOUBLE - {LAW_S}) / nullif({LAW_K}, 0), 2) END AS breakeven,
            coalesce(ssr_next, false) = false AND coalesce(dvol20 >= 300000, false) AS publishable,
            CASE WHEN status = 'NONE' THEN 'no borrow' WHEN squeeze_danger >= 70 THEN 'squeeze danger'
              WHEN high = low THEN 'halted' WHEN cap_borrow < 30000 THEN 'not lendable for the size' END AS zone_reason,
            list_filter([CASE WHEN offered THEN 'OFFERING 24H' END, CASE WHEN has_atm THEN 'ATM' END,
              CASE WHEN gap_pct >= 0.1 THEN 'GAP UP' END, CASE WHEN r3 >= 0.3 THEN 'RUN 3D' END,
              CASE WHEN status = 'NONE' THEN 'NO BORROW' END, CASE WHEN high = low THEN 'HALTED' END,
              CASE WHEN country = 'Singapore' THEN 'ASIA' END, CASE WHEN dd_52w <= -0.2 THEN 'DRAWDOWN' END],
              lambda x: x IS NOT NULL) AS flags
          FROM (SELECT *, avg(CASE WHEN oc <= -0.05 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY session) AS base FROM danger) d))"""),
    "board": (("picks",), "SELECT *, board_rank AS rank FROM picks WHERE board_rank IS NOT NULL"),
}
