"""Cost, breakeven and capacity laws as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .scalars import _c, finite


def impact_cost(size, sigma, volume, spread) -> Column:
    """Round trip: square-root impact on both legs plus one spread."""
    return 2 * fixed.IMPACT_Y * _c(sigma) * F.sqrt(F.try_divide(_c(size), _c(volume))) + _c(spread)


def participation(size, volume) -> Column:
    return F.try_divide(_c(size), _c(volume))


def law_spread(spread) -> Column:
    return F.greatest(finite(spread), F.lit(0.001))


def law_k(c10, spread) -> Column:
    """Slope of the square-root law backed out of the cost at 10,000."""
    return F.greatest(finite(c10) - law_spread(spread), F.lit(0.0)) / 100.0


def cost_law(size, c10, spread) -> Column:
    """s + k * sqrt(size); missing when either input is."""
    known = finite(c10).isNotNull() & finite(spread).isNotNull()
    return F.when(known, law_spread(spread) + law_k(c10, spread) * F.sqrt(F.greatest(_c(size), F.lit(0.0))))


def cost_at(costs, size: int, c10, spread) -> Column:
    """Published cost at that size, else the law."""
    return F.coalesce(finite(F.try_element_at(_c(costs), F.lit(str(size)))), cost_law(F.lit(float(size)), c10, spread))


def breakeven(move, c10, spread) -> Column:
    """Largest size whose cost is within `move`; missing where even the spread is not."""
    s, k = law_spread(spread), law_k(c10, spread)
    return F.when(_c(move) > s, F.pow(F.try_divide(_c(move) - s, k), F.lit(2.0)))


def expected_volume(dvol20, dvol5) -> Column:
    """Conservative expected dollar volume: the smaller of two averages (our choice)."""
    return F.least(_c(dvol20), _c(dvol5))


def volume_cap(volume) -> Column:
    return fixed.MAX_PARTICIPATION * _c(volume)


def impact_cap(volume, sigma) -> Column:
    """Size at which one leg's impact reaches the limit."""
    return _c(volume) * F.pow(F.try_divide(F.lit(fixed.MAX_IMPACT), fixed.IMPACT_Y * _c(sigma)), F.lit(2.0))


def capacity(volume, sigma, lendable) -> Column:
    """Smallest known cap; missing when volume is."""
    return F.when(_c(volume).isNotNull(), F.least(volume_cap(volume), impact_cap(volume, sigma), _c(lendable)))


def binding_limit(volume, sigma, lendable) -> Column:
    cap = capacity(volume, sigma, lendable)
    return (
        F.when(cap == volume_cap(volume), "volume").when(cap == impact_cap(volume, sigma), "impact")
        .when(cap == _c(lendable), "borrow")
    )
