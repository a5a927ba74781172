"""Column-to-column expressions. All native, all null in / null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """NaN and infinities are missing."""
    x = _c(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def half_up(x) -> Column:
    """Nearest integer, halves toward plus infinity."""
    return F.floor(_c(x) + 0.5)


def logistic(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def humanise(code) -> Column:
    """`some_code` -> `Some code`."""
    s = F.replace(_c(code), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.length(s)))


# ── time ────────────────────────────────────────────────────────────────────

def parse_day(s) -> Column:
    """Day of a text that starts with `YYYY-MM-DD`; anything else is missing.

    Out-of-range months and days roll over (`2024-02-31` is 2 March) and the
    two-digit years 0000-0099 are read as 19xx.
    """
    s = _c(s)
    part = lambda i: F.regexp_extract(s, r"^(\d{4})-(\d{2})-(\d{2})", i).try_cast("int")
    year = F.when(part(1) < 100, part(1) + 1900).otherwise(part(1))
    day = F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), part(2) - 1), part(3) - 1)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), day)


def parse_ts(s) -> Column:
    """Instant of an ISO text (seconds may be left out); a bare date is not an instant, bad text is missing."""
    s = _c(s)
    timed = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(?=$|[Z+-])", "$1:00")
    return F.when(~s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(timed))


def eastern(ts) -> Column:
    """US Eastern wall clock of an instant (session zone UTC)."""
    return F.from_utc_timestamp(_c(ts), "America/New_York")


def et_date(ts) -> Column:
    return F.to_date(eastern(ts))


def et_hhmm(ts) -> Column:
    return F.date_format(eastern(ts), "HH:mm")


def et_minute(ts) -> Column:
    wall = eastern(ts)
    return F.hour(wall) * 60 + F.minute(wall)


def market_phase(ts) -> Column:
    """closed | pre-market | open | after-hours of an instant."""
    m, day = et_minute(ts), et_date(ts)
    closed_day = F.dayofweek(day).isin(1, 7) | F.date_format(day, "yyyy-MM-dd").isin(fixed.HOLIDAYS)
    return (
        F.when(_c(ts).isNull(), F.lit(None).cast("string"))
        .when(closed_day, "closed")
        .when((m >= fixed.PRE_MARKET_FROM) & (m < fixed.OPEN_FROM), "pre-market")
        .when((m >= fixed.OPEN_FROM) & (m < fixed.AFTER_HOURS_FROM), "open")
        .when((m >= fixed.AFTER_HOURS_FROM) & (m < fixed.AFTER_HOURS_TO), "after-hours")
        .otherwise("closed")
    )


def days_between(a, b) -> Column:
    """P5: how many dates `b` lies after `a`; negative if before."""
    return F.datediff(_c(b), _c(a))


def age(ts, now) -> Column:
    """struct(unit, amount): just now (<90 s), min (<60), h (<36), days."""
    sec = F.greatest(F.lit(0.0), (F.unix_micros(_c(now)) - F.unix_micros(_c(ts))) / 1e6)
    minutes, hours = sec / 60, sec / 3600
    unit = F.when(sec < 90, "just now").when(minutes < 60, "min").when(hours < 36, "h").otherwise("days")
    amount = (
        F.when(sec < 90, F.lit(0).cast("bigint")).when(minutes < 60, half_up(minutes))
        .when(hours < 36, half_up(hours)).otherwise(half_up(hours / 24))
    )
    known = _c(ts).isNotNull()
    return F.struct(F.when(known, unit).alias("unit"), F.when(known, amount).alias("amount"))


# ── text ────────────────────────────────────────────────────────────────────

_HTTP = r"^\s*(?i:https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\s]+)"


def safe_url(u) -> Column:
    """The address if it is absolute http or https, else missing."""
    u = _c(u)
    return F.when(u.rlike(_HTTP), F.btrim(u, F.lit(" \t\n\x0b\f\r")))


def url_host(u) -> Column:
    """Lower-case host of an http(s) address without a leading `www.`."""
    u = _c(u)
    host = F.lower(F.regexp_extract(u, _HTTP, 1))
    return F.when(u.rlike(_HTTP), F.regexp_replace(host, r"^www\.", ""))


def flag_class(flag) -> Column:
    flag = _c(flag)
    return F.when(flag.rlike(fixed.RED_FLAG), "red").when(flag.rlike(fixed.SOLID_FLAG), "solid").otherwise("plain")


def report_time(s) -> Column:
    """Before/after the session by the words in the code."""
    s = F.coalesce(_c(s), F.lit(""))
    return F.when(s.contains("pre"), "before the open").when(s.contains("after"), "after the close").otherwise("time n/a")


def calendar_time(s) -> Column:
    """Known report-time codes by the fixed map, others humanised."""
    s = _c(s)
    known = F.create_map(*[F.lit(x) for kv in fixed.REPORT_TIMES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, s), F.when(s != "", humanise(s)))


def region_linked(flags, country) -> Column:
    by_flag = F.coalesce(F.array_contains(_c(flags), "ASIA"), F.lit(False))
    return by_flag | F.coalesce(_c(country).isin(fixed.ASIA), F.lit(False))


def stance(polarity) -> Column:
    polarity = _c(polarity)
    return F.when(polarity < 0, "bearish").when(polarity > 0, "bullish").otherwise("none")


# ── readings ────────────────────────────────────────────────────────────────

def danger_word(v) -> Column:
    v = finite(v)
    return F.when(v.isNull(), "unknown").when(v >= 70, "high").when(v >= 45, "elevated").otherwise("low")


def danger_cells(v) -> Column:
    """0-10 lit cells of the meter."""
    v = finite(v)
    return F.when(v.isNotNull(), half_up(F.least(F.greatest(v, F.lit(0.0)), F.lit(100.0)) / 10))


def ratio(a, b) -> Column:
    return F.try_divide(_c(a), _c(b))


def lift(p, base) -> Column:
    return ratio(p, base)


def down_skew(dump, pump) -> Column:
    """Share of the two big-move odds that points down."""
    return ratio(dump, _c(dump) + _c(pump))


def at_cap(p, model, caps: dict[str, float]) -> Column:
    """True where the reading sits at its model's cap; unknown models make no claim."""
    held = F.lit(None).cast("double")
    for name, cap in caps.items():
        held = F.when(_c(model) == name, F.lit(cap)).otherwise(held)
    return F.coalesce(_c(p) >= held - 1e-4, F.lit(False))


def edge_percentile(edge) -> Column:
    return half_up((0.5 - _c(edge)) * 100)


def outcome_label(missing, dump, squeezed) -> Column:
    return (
        F.when(F.coalesce(_c(missing), F.lit(False)), "no data").when(_c(dump), "dumped")
        .when(_c(squeezed), "squeezed").when(~_c(dump), "no dump")
    )


def short_net(move, cost) -> Column:
    return -_c(move) - _c(cost)


def short_word(net) -> Column:
    net = _c(net)
    return F.when(F.abs(net) < 0.0005, "broke even").when(net < 0, "lost").when(net.isNotNull(), "made")


def move_from_open(x, open_) -> Column:
    """x/open - 1; a zero or missing open gives no move."""
    open_ = _c(open_)
    return F.when(open_ != 0, _c(x) / open_ - 1)


def outcome_flags(oc, oh) -> dict[str, Column]:
    oc, oh = _c(oc), _c(oh)
    return {
        "dump5": oc <= fixed.DUMP, "d3": oc <= fixed.FALL_3, "big10": oc <= fixed.BIG_FALL,
        "bigdump15": oc <= fixed.BIG_DUMP, "pump5": oc >= fixed.PUMP, "up10": oc >= fixed.UP_10,
        "squeeze20": oh >= fixed.SQUEEZE,
    }


def runway(cash, quarterly_burn) -> Column:
    return ratio(cash, quarterly_burn)


def first_finite(*xs) -> Column:
    """First finite value: a base rate and its fallbacks."""
    return F.coalesce(*[finite(x) for x in xs])


def risk_adjusted(score, risk) -> Column:
    """score x (1 - risk); both are shown on 0-100 (our choice of scale)."""
    return _c(score) * (1 - _c(risk) / 100)
