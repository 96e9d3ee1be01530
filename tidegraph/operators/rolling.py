"""Rolling totals over trailing days, kept as a versioned state of each entity and day.

A day's state is yesterday's totals, plus today's arrivals, minus the amounts of the day that leaves each window.
advance() does this for a block of days at once: yesterday's totals (the closing state of the block before) are joined
with the block's signed changes, arrivals entering on their day and leaving length days later, and a running sum over
them gives the state of each day, held as intervals in which nothing changes. A block reads only its own days and the
longest window before them; its states are written, and the next block starts from them. correct() writes new versions of
the days that a correction reaches, and readers take the latest version of each day.

Defined results: rows without entity or time do not count; repeated deliveries of one record count once; a null measure
counts as a record but not in totals and averages; an average over no measured record is null; empty input gives an
empty result; tied times don't matter; extra columns are ignored; a correction of days never reached changes nothing.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.session import cut

SCALE = 1_000_000


def daily_amounts(rows: DataFrame, entity: str, time: str, record: str, measure: str) -> DataFrame:
    """(entity, day, n, n_measured, units) over distinct records; the day is in UTC.

    Distinct records come first, by a hash of the record: a hot entity's deliveries spread over all tasks.
    """
    r = rows.filter(F.col(entity).isNotNull() & F.col(time).isNotNull())
    r = r.select(F.col(entity).alias("entity"), F.to_date(F.col(time).cast("timestamp")).alias("day"), F.col(record).alias("record"), F.round(F.col(measure) * SCALE).cast("long").alias("units"))
    r = r.groupBy("record", "entity", "day").agg(F.max("units").alias("units"))
    return r.groupBy("entity", "day").agg(F.count("*").alias("n"), F.count("units").alias("n_measured"), F.coalesce(F.sum("units"), F.lit(0)).alias("units"))


_AMOUNTS = ("n", "n_measured", "units")


def changes(daily: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Signed changes of the windows' totals: + on the day, - when it leaves the window."""
    parts = []
    for after in (0, *lengths):
        cols = [
            (F.col(a) if after == 0 else -F.col(a) if after == d else F.lit(0)).cast("long").alias(f"{a}_{d}")
            for d in lengths
            for a in _AMOUNTS
        ]
        parts.append(F.struct(F.date_add("day", after).alias("day"), *cols))
    exploded = daily.select("entity", F.explode(F.array(*parts)).alias("c")).select("entity", "c.*")
    return exploded.groupBy("entity", "day").agg(*(F.sum(c).alias(c) for c in exploded.columns[2:]))


def _totals(lengths: tuple[int, ...]) -> list[str]:
    return [f"{a}_{d}" for d in lengths for a in _AMOUNTS]


def empty_state(daily: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """The closing state before the first day: no entity."""
    return daily.filter("false").select("entity", *(F.lit(0).cast("long").alias(x) for x in _totals(lengths)))


def advance(closing: DataFrame, daily: DataFrame, first: date, last: date, lengths: tuple[int, ...] = (7, 30), version: int = 0) -> DataFrame:
    """(entity, day, until, version, totals...): the states of the days first..last from the totals at the end of the day before.

    closing: (entity, totals...); the states hold from day to the day before until. Entities whose windows are empty have
    no row. One full outer join by entity and day, and one running sum over an entity's changes within the block.
    """
    a, b, names = F.lit(first), F.lit(last), _totals(lengths)
    new = changes(daily.filter(F.col("day").between(F.date_sub(a, max(lengths)), b)), lengths).filter(F.col("day").between(a, b))
    old = closing.select("entity", a.alias("day"), *(F.col(x).alias(f"_{x}") for x in names))
    j = old.join(new, ["entity", "day"], "full_outer").select("entity", "day", *((F.coalesce(F.col(x), F.lit(0)) + F.coalesce(F.col(f"_{x}"), F.lit(0))).alias(x) for x in names))
    w = Window.partitionBy("entity").orderBy("day")
    s = j.select("entity", "day", F.coalesce(F.lead("day").over(w), F.date_add(b, 1)).alias("until"), F.lit(version).alias("version"), *(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias(x) for x in names))
    return s.filter(F.greatest(*(F.col(f"n_{d}") for d in lengths)) > 0)


def closing_state(states: DataFrame, last: date, lengths: tuple[int, ...] = (7, 30)) -> DataFrame:
    """(entity, totals...) at the end of the last day, from the latest version of it."""
    names = _totals(lengths)
    s = states.filter((F.col("day") <= F.lit(last)) & (F.col("until") > F.lit(last)))
    s = s.groupBy("entity").agg(F.max_by(F.struct(*names), "version").alias("s")).select("entity", "s.*")
    return s.filter(F.greatest(*(F.col(f"n_{d}") for d in lengths)) > 0)


def correct(states: DataFrame, corrections: DataFrame, first: date, last: date, lengths: tuple[int, ...] = (7, 30), version: int = 1) -> DataFrame:
    """New versions, day by day, of the states that corrections (entity, day, n, n_measured, units as differences) reach.

    A correction of a day touches that day and those up to the longest length after it, within the days first..last that
    the states cover; all other states keep their version and are not rewritten. A day emptied by a correction gets a
    version with zeros.
    """
    names = _totals(lengths)
    reach = corrections.select("entity", F.col("day").alias("at"), *_AMOUNTS, F.explode(F.sequence(F.lit(0), F.lit(max(lengths) - 1))).alias("k")).withColumn("day", F.date_add("at", F.col("k")))
    reach = reach.filter(F.col("day").between(F.lit(first), F.lit(last)))
    delta = reach.groupBy("entity", "day").agg(*(F.sum(F.when(F.col("k") < d, F.col(a)).otherwise(0)).cast("long").alias(f"d_{a}_{d}") for d in lengths for a in _AMOUNTS))
    touched = delta.groupBy("entity").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    old = states.join(touched, "entity").filter((F.col("day") <= F.col("hi")) & (F.col("until") > F.col("lo")))
    old = old.select("entity", F.explode(F.sequence(F.greatest("day", "lo"), F.least(F.date_sub("until", 1), F.col("hi")))).alias("day"), "version", *names)
    old = old.groupBy("entity", "day").agg(F.max_by(F.struct(*names), "version").alias("s")).select("entity", "day", "s.*")
    j = delta.join(old, ["entity", "day"], "left")
    return j.select("entity", "day", F.date_add("day", 1).alias("until"), F.lit(version).alias("version"), *((F.coalesce(F.col(x), F.lit(0)) + F.col(f"d_{x}")).cast("long").alias(x) for x in names))


def stored_states(daily: DataFrame, last: date, lengths: tuple[int, ...] = (7, 30), block_days: int = 92) -> DataFrame:
    """The states of all days up to `last`, advanced in blocks of block_days, each written to the shared folder and started from the one before."""
    daily = cut(daily, "daily")
    span = daily.agg(F.min("day").alias("a")).first()
    at, closing = span.a or last, empty_state(daily, lengths)
    out: DataFrame | None = None
    while out is None or at <= last:
        end = min(at + timedelta(days=block_days - 1), max(last, at))
        block = cut(advance(closing, daily, at, end, lengths), "states")
        out, closing, at = block if out is None else out.unionByName(block), closing_state(block, end, lengths), end + timedelta(days=1)
    return out


def latest_days(states: DataFrame, corrected: DataFrame | None = None) -> DataFrame:
    """(entity, day, totals...): one row for each day of the states, in its latest version; corrected: what correct() gave."""
    days = states.withColumn("day", F.explode(F.sequence("day", F.date_sub("until", 1)))).drop("until")
    if corrected is None:
        return days.drop("version")
    fixed = corrected.drop("until").groupBy("entity", "day").agg(F.max_by(F.struct(*[c for c in days.columns if c not in ("entity", "day", "version")]), "version").alias("s")).select("entity", "day", "s.*")
    return days.join(fixed.select("entity", "day"), ["entity", "day"], "left_anti").drop("version").unionByName(fixed)


def _average(d: int) -> Column:
    return F.round(F.expr(f"try_divide(units_{d}, n_measured_{d})") / SCALE, 6).alias(f"mean_{d}d")


def rolling_daily(rows: DataFrame, entity: str, time: str, record: str, measure: str, last_day: str, lengths: tuple[int, ...] = (7, 30)) -> DataFrame:
    """One row for each entity and calendar day, silent days included, from its first day to last_day, read from the stored states."""
    daily, last = daily_amounts(rows, entity, time, record, measure), date.fromisoformat(last_day)
    names = _totals(lengths)
    s = stored_states(daily, last, lengths).filter(F.col("day") <= F.lit(last)).select("entity", "day", "until", *names)
    w = Window.partitionBy("entity").orderBy("day")
    # stretches with empty windows have no state; they are silent days of zeros
    end = F.date_add(F.lit(last), 1)
    quiet = s.select("entity", F.col("until").alias("day"), F.coalesce(F.lead("day").over(w), end).alias("until"), *(F.lit(0).cast("long").alias(x) for x in names)).filter("day < until")
    s = s.unionByName(quiet).withColumn("day", F.explode(F.sequence("day", F.date_sub("until", 1))))
    cols = [x for d in lengths for x in (F.col(f"n_{d}").alias(f"n_{d}d"), F.round(F.col(f"units_{d}") / SCALE, 6).alias(f"total_{d}d"), _average(d))]
    return s.select(F.col("entity").alias(entity), F.date_format("day", "yyyy-MM-dd").alias("day"), *cols)


def burst_days(rows: DataFrame, entity: str, time: str, record: str, measure: str, least: int = 5, share: float = 0.75, first_day: str = "2023-02-01", last_day: str = "2024-12-31") -> DataFrame:
    """(entity, day) with at least `least` records in 7 days that are at least `share` of those in 30 days, read from the stored states.

    The test runs on intervals of equal state; only those that pass are expanded to days.
    """
    first, last = date.fromisoformat(first_day), date.fromisoformat(last_day)
    s = stored_states(daily_amounts(rows, entity, time, record, measure), last)
    s = s.filter((F.col("n_7") >= least) & (F.col("n_7") >= F.col("n_30") * share))
    s = s.select("entity", F.greatest("day", F.lit(first)).alias("a"), F.least(F.date_sub("until", 1), F.lit(last)).alias("b")).filter("a <= b")
    return s.select("entity", F.explode(F.sequence("a", "b")).alias("day")).select(F.col("entity").alias(entity), F.date_format("day", "yyyy-MM-dd").alias("day"))
