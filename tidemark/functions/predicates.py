"""Filters of the board, the lookup and the gates: never-null booleans."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .scalars import _c, et_date, finite, region_linked


def known(pred: Column) -> Column:
    """A predicate over missing values does not hold."""
    return F.coalesce(pred, F.lit(False))


def all_of(preds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, [known(p) for p in preds], F.lit(True))


def shortable(status="status", available="available") -> Column:
    """Lendable, and not known to be out of shares."""
    return known(_c(status).isin("ETB", "HTB")) & ~known(finite(available) <= 0)


def fits_size(size, capacity="capacity") -> Column:
    return known(finite(capacity) >= size)


def board_filters(size: float = fixed.BOARD_MIN_USD) -> dict[str, Column]:
    return {
        "shortable": shortable(),
        "nosq": known(finite("squeeze_danger") < 45),
        "asia": region_linked(F.col("flags"), F.col("country")),
        "offer24": known(F.col("fresh_supply")),
        "sub1": known(finite("price") < 1),
        "fits": fits_size(size),
    }


def lookup_filters() -> dict[str, Column]:
    return {
        "short": known(F.col("status").isin("ETB", "HTB")),
        "nossr": ~known(F.col("ssr")),
        "sub1": known(finite("price") < 1),
        "board": F.col("board_rank").isNotNull(),
        "fits500": known(finite("capacity") >= 5e5),
    }


def search_match(query: str, symbol="symbol", name="name") -> Column:
    """Ticker prefix or name fragment, any case. An empty query matches all."""
    q = query.strip().lower()
    if not q:
        return F.lit(True)
    return known(F.lower(_c(symbol)).startswith(q)) | known(F.lower(_c(name)).contains(q))


def search_order(query: str, pos: str, symbol="symbol") -> list[Column]:
    """Exact ticker first, then source order."""
    return [(F.lower(_c(symbol)) == query.strip().lower()).desc(), F.col(pos).asc()]


def fresh_supply(category, accepted, day, publish) -> Column:
    """A supply filing in the 24 hours before publish.

    With an instant: from 24 h before to 1 h after. With a day only: that day is
    not before the Eastern day 24 h earlier.
    """
    cutoff = _c(publish) - F.expr("INTERVAL 24 HOURS")
    by_instant = (_c(accepted) >= cutoff) & (_c(accepted) <= _c(publish) + F.expr("INTERVAL 1 HOUR"))
    by_day = _c(day) >= et_date(cutoff)
    recent = F.when(_c(accepted).isNotNull(), by_instant).otherwise(by_day)
    return known(_c(category).isin(fixed.SUPPLY_CATEGORIES) & recent)


def tradable(size: float, price="price", volume="exp_dvol", sigma="vol20") -> Column:
    """Price of a dollar or more; `size` within volume and impact limits."""
    from .sizing import impact_cap, volume_cap
    return known((_c(price) >= 1) & (volume_cap(volume) >= size) & (impact_cap(volume, sigma) >= size))


def publishable(ssr="ssr_next", dollar_volume="dvol20") -> Column:
    """No short-sale restriction and enough dollars traded a day."""
    return ~known(_c(ssr)) & known(_c(dollar_volume) >= fixed.MIN_DOLLAR_VOLUME)


def zone_reason(size: float = fixed.BOARD_MIN_USD) -> Column:
    """First reason a name is held off the board, or missing (our order of reasons)."""
    return (
        F.when(F.col("status") == "NONE", "no borrow")
        .when(F.col("squeeze_danger") >= 70, "squeeze danger")
        .when(F.col("high") == F.col("low"), "halted")
        .when(F.col("cap_borrow") < size, "not lendable for the size")
    )


def stand_aside(bench_return, p_fall, tier, weak: float = -0.01, bar: float = 0.5,
                kept: tuple[str, ...] = ("high", "medium")) -> Column:
    """First reason for no trade: weak tape, low conviction, low tier."""
    return (
        F.when(_c(bench_return) <= weak, "tape").when(_c(p_fall) < bar, "conviction")
        .when(~_c(tier).isin(*kept), "tier")
    )


def present(*cols) -> Column:
    """Keys are there and not empty."""
    return all_of([_c(c).isNotNull() & (_c(c).cast("string") != "") for c in cols])


def small_sample(n, at_least: int) -> Column:
    return _c(n) < at_least
