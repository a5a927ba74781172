"""Joins by time, by range and by precedence.

No join here compares all pairs of a group: instants are matched through time
buckets, calendars through small broadcast tables, and bands through broadcast reports of a
checked size or a sweep.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from .ranking import beside, running_extreme, top_k, with_group_agg


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str,
              take: Sequence[str], grain: str = "MONTH", prefix: str = "") -> DataFrame:
    """Attach to each left row the latest right row of its key with right_on <= left_on.

    Works inside (key, time bucket) groups; what a bucket lacks is carried from
    the last earlier bucket of the key. A key with most of the rows is spread
    over its buckets, and the carry sees one row per bucket of the calendar.
    Only distinct instants are placed, and the instant found is all that a sort or an
    aggregate holds: the columns taken, and the left rows, meet it by equality afterwards, in
    joins that can be split, however many rows share an instant.
    `right` holds one row per (key, right_on).
    """
    by = list(by)
    asked = left.withColumn("_t", F.col(left_on).cast("timestamp"))
    held = right.select(*by, F.col(right_on).cast("timestamp").alias("_at"), F.lit(False).alias("_none"), F.struct(*take).alias("_hit"))
    l = asked.select(*by, "_t").distinct().select(*by, "_t", F.lit(1).alias("_side"), F.lit(None).cast("timestamp").alias("_at"))
    r = held.select(*by, F.col("_at").alias("_t"), F.lit(0).alias("_side"), "_at")
    rows = l.unionByName(r).withColumn("_bucket", F.date_trunc(grain, "_t"))

    inside = W.partitionBy(*by, "_bucket").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    per_bucket = rows.groupBy(*by, "_bucket").agg(F.max("_at").alias("_last"))
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = per_bucket.select(*by, "_bucket", F.max("_last").over(earlier).alias("_carried"))
    met = rows.withColumn("_in", F.max("_at").over(inside)).filter(F.col("_side") == 1)
    out = met.join(carried, [*by, "_bucket"], "left").select(*by, "_t", F.coalesce("_in", "_carried").alias("_at"))
    # a row without an instant of its own meets a right row without one, a row that nothing precedes meets none
    out = out.withColumn("_none", F.col("_at").isNull() & F.col("_t").isNotNull())
    out = beside(out, held, [*by, "_at", "_none"], "left", known=["_none"]).select(*by, "_t", "_hit")
    return beside(asked, out, [*by, "_t"], "left").select(*left.columns, *[F.col(f"_hit.{c}").alias(prefix + c) for c in take])


def latest_before(rows: DataFrame, by: Sequence[str], ts: str, keep: Column, take: Sequence[str]) -> DataFrame:
    """Last row per key among those that satisfy `keep` (a cutoff); combines inside the scan tasks."""
    return rows.filter(keep).groupBy(*by).agg(F.max_by(F.struct(*take), F.col(ts)).alias("_m")).select(*by, "_m.*")


#: Rows of a report of bands that is broadcast; a longer one is met in a sweep.
BROADCAST_BANDS = 10_000


def band_join(rows: DataFrame, bands: DataFrame, value: str, broadcast_rows: int = BROADCAST_BANDS) -> DataFrame:
    """Band `lo <= value <= hi`; a value outside all of them, or missing, falls into the last band.

    `bands` are disjoint. A report of `broadcast_rows` at most is broadcast. A longer one is sorted among the rows by
    where each begins; a row's band can only be the last that began before it.
    """
    names = bands.columns
    last = bands.agg(F.max_by(F.struct(*names), "lo").alias("last"))
    few = bands.limit(broadcast_rows + 1).count() <= broadcast_rows
    if few:
        hit = rows.join(F.broadcast(bands.select(F.struct(*names).alias("_band"))),
                        (F.col(value) >= F.col("_band.lo")) & (F.col(value) <= F.col("_band.hi")), "left")
        return hit.withColumn("_band", F.coalesce("_band", last.scalar())).select(*rows.columns, "_band.*")
    began = F.struct("lo", *[c for c in names if c != "lo"])
    # rows of one value lie together after the band that begins there; a shared value is one row of the sweep
    values = rows.filter(F.col(value).isNotNull()).select(F.col(value).alias("_at")).distinct().select("_at", F.lit(1).alias("_side"), F.lit(None).cast(
        bands.select(began.alias("b")).schema["b"].dataType).alias("_began"))
    starts = bands.select(F.col("lo").alias("_at"), F.lit(0).alias("_side"), began.alias("_began"))
    swept = running_extreme(starts.unionByName(values), [], [F.col("_at"), F.col("_side")], "_began", "_band", largest=True, itself=True)
    met = swept.filter("_side = 1").select("_at", F.when(F.col("_at") <= F.col("_band.hi"), F.col("_band")).alias("_band"))
    hit = rows.join(met, F.col(value) == F.col("_at"), "left").withColumn("_band", F.coalesce("_band", last.select(
        F.struct(F.col("last.lo"), *[F.col(f"last.{c}") for c in names if c != "lo"]).alias("last")).scalar()))
    return hit.select(*rows.columns, *[F.col(f"_band.{c}") for c in names])


def disjoint_bands(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Drop bands that strictly contain another band of the same report.

    A sweep from the highest start down: a band holds another if some band that begins later ends no later, or one that begins
    with it ends earlier. No band is compared with another, and nothing is broadcast. A band without both ends stays.
    """
    by = list(by)
    least = report.dropna(subset=["lo", "hi", *by]).groupBy(*by, "lo").agg(F.min("hi").alias("_here"))
    swept = running_extreme(least, by, [F.col("lo").desc()], "_here", "_later", largest=False, itself=False)
    met = beside(report, swept, [*by, "lo"], "left")
    holds = (F.col("_later") <= F.col("hi")) | (F.col("_here") < F.col("hi"))
    return met.filter(~F.coalesce(holds, F.lit(False))).select(*report.columns)


def merge_records(lists: DataFrame, by: Sequence[str], precedence: Sequence[str], side: Sequence[str]) -> DataFrame:
    """One row per key: the first list in `precedence` wins the whole row.

    `lists` holds (keys, list, pos, ...). Lists named in `side` also attach as
    struct columns `as_<list>`, except where the record itself comes from there
    (a lookalike attaches even then). A record won by `top` reads as a board one.
    """
    at = F.array_position(F.array(*[F.lit(p) for p in precedence]), F.col("list"))
    prio = F.when(at > 0, at).otherwise(len(precedence) + 1)         # a list without a place comes last
    whole = W.partitionBy(*by)               # a key holds one row per list
    rest = F.struct(*[c for c in lists.columns if c not in (*by, "list")])
    beside = {s: F.min_by(rest, F.when(F.col("list") == s, F.col("pos"))).over(whole) for s in side}
    placed = lists.select("*", F.row_number().over(whole.orderBy(prio, "pos")).alias("_k"),
                          *[c.alias(f"_s_{s}") for s, c in beside.items()])
    where = F.when(F.col("list") == "top", "board").otherwise(F.col("list"))
    keep = lambda s: F.lit(True) if s == "twin" else F.col("list") != s
    return placed.filter(F.col("_k") == 1).select(
        *[c for c in lists.columns if c != "list"], where.alias("where"),
        *[F.when(keep(s), F.col(f"_s_{s}")).alias(f"as_{s}") for s in side])


def mark_known(rows: DataFrame, keys: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """True where the row's key is among `keys`."""
    seen = keys.select(*on).distinct().withColumn("_seen", F.lit(True))
    return rows.join(seen, list(on), "left").withColumn(name, F.coalesce("_seen", F.lit(False))).drop("_seen")


def first_passing(rows: DataFrame, by: str, rank: str, passes: Column, small: bool = False) -> DataFrame:
    """Per group the best-ranked row that passes, and the rows passed over above it.

    Long form with `role`, so a group that passes over many names stays rows.
    """
    met = with_group_agg(rows, by, {"_pick": F.min(F.when(passes, F.col(rank)))}, small)
    met = met.filter(F.col(rank) <= F.col("_pick"))
    return met.withColumn("role", F.when(F.col(rank) == F.col("_pick"), "picked").otherwise("passed over")).drop("_pick")


def zscores(rows: DataFrame, by: str, cols: Sequence[str], small: bool = False) -> DataFrame:
    """Group z-scores; a column without spread, or a missing value, scores 0 (typical)."""
    stats = {f"_m_{c}": F.avg(c) for c in cols} | {f"_d_{c}": F.stddev_samp(c) for c in cols}
    joined = with_group_agg(rows, by, stats, small)
    z = [F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_d_{c}")), F.lit(0.0)).alias(f"z_{c}") for c in cols]
    return joined.select(*rows.columns, *z)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0),
                                   lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def lookalikes(rows: DataFrame, by: str, key: str, vector: Column, anchor: Column, k: int, at_least: float,
               small: bool = False) -> DataFrame:
    """The k names of each group most like its anchor, with similarity of at least the bar.

    Similarity is the cosine of the feature vectors (our formula). The anchor is
    the row of the group with the smallest `anchor`.
    """
    found = {"_a": F.min_by(F.struct(F.col(key).alias("key"), vector.alias("v")), anchor)}
    near = with_group_agg(rows, by, found, small).select(
        "*", F.col("_a.key").alias("anchor"), F.round(cosine(vector, F.col("_a.v")), 9).alias("similarity"))
    near = near.filter((F.col(key) != F.col("anchor")) & (F.col("similarity") >= at_least)).drop("_a")
    return top_k(near, by, [F.col("similarity").desc(), F.col(key)], k, "twin_rank")


def calendar_days(sessions: DataFrame) -> DataFrame:
    """day -> index of the first session after it; as many rows as the calendar has days."""
    numbered = sessions.select("session", F.row_number().over(W.orderBy("session")).cast("bigint").alias("idx"))
    prev = F.lag("session").over(W.orderBy("session"))
    spans = numbered.withColumn("_from", F.coalesce(prev, F.date_sub("session", 31)))
    return spans.select("idx", F.explode(F.sequence("_from", F.date_sub("session", 1))).alias("day"))


def next_sessions(sessions: DataFrame, n: int) -> DataFrame:
    """The n weekdays after the last session that are no holidays."""
    last = sessions.agg(F.max("session").alias("_m"))
    days = last.select(F.explode(F.sequence(F.date_add("_m", 1), F.date_add("_m", 2 * n + 14))).alias("session"))
    trading = ~F.dayofweek("session").isin(1, 7) & ~F.date_format("session", "yyyy-MM-dd").isin(fixed.HOLIDAYS)
    return days.filter(trading).orderBy("session").limit(n)


def upcoming_events(events: DataFrame, sessions: DataFrame, date: str, n: int) -> DataFrame:
    """Pair each event with the sessions s for which it falls in (s, s + n sessions].

    An event is given the index of the session that closes its interval; it then
    belongs to the n sessions before that index. Each event gives at most n rows.
    Beyond the last session the calendar goes on by weekdays without holidays.
    """
    known = sessions
    sessions = known.select("session").unionByName(next_sessions(known, n))
    days = calendar_days(sessions)
    numbered = sessions.select("session", F.row_number().over(W.orderBy("session")).cast("bigint").alias("idx"))
    # (s_i, s_i+1] has closing index i+1; a date equal to a session closes at that session
    closing = events.join(F.broadcast(days.select(F.date_add("day", 1).alias("_d"), F.col("idx").alias("_close"))),
                          F.col(date) == F.col("_d"))
    spread = closing.withColumn("idx", F.explode(F.sequence(F.col("_close") - n, F.col("_close") - 1)))
    numbered = numbered.join(F.broadcast(known.select("session")), "session", "left_semi")
    return spread.join(F.broadcast(numbered), "idx").withColumn(
        "sessions_ahead", F.col("_close") - F.col("idx")).drop("idx", "_close", "_d")


def has_event_between(rows: DataFrame, events: DataFrame, by: Sequence[str], lo: str, hi: str, day: str) -> DataFrame:
    """Keep rows with an event of their key in (lo, hi] (days).

    Events are first reduced to one row per key and day; a row then needs only the
    last event day up to the end of its interval. Equal rows all stay.
    """
    held = events.select(*by, F.col(day).alias("_day")).distinct()
    return asof_join(rows, held, by, hi, "_day", ["_day"]).filter(F.col("_day") > F.col(lo)).drop("_day")


def trailing_counts(events: DataFrame, by: Sequence[str], day: str, counted: dict[str, tuple[Column, int]],
                    last: dict[str, Column] | None = None) -> DataFrame:
    """Events of a kind in the last n calendar days, per key and day that has events.

    Counted per (key, day) first, so the range window sees one row per day. `last`
    names kinds whose latest day so far is wanted.
    """
    last = last or {}
    daily = events.groupBy(*by, day).agg(
        *[F.count_if(c).alias(f"_n_{n}") for n, (c, _) in counted.items()],
        *[F.bool_or(c).alias(f"_h_{n}") for n, c in last.items()])
    w = W.partitionBy(*by).orderBy(F.unix_date(F.col(day)))
    out = [F.sum(f"_n_{n}").over(w.rangeBetween(1 - span, 0)).alias(n) for n, (_, span) in counted.items()]
    out += [F.max(F.when(F.col(f"_h_{n}"), F.col(day))).over(w.rowsBetween(W.unboundedPreceding, 0)).alias(n) for n in last]
    return daily.select(*by, day, *out)
