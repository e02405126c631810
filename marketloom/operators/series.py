"""Daily series per card: calendars, alignment, filling, lags.

Every function takes at most one row per card and day. A card's window then
holds no more rows than the calendar has days, however many sales lie behind
it, which is what makes windows per card safe here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = "cardname"
DAY = "date"


def by_day():
    return W.partitionBy(KEY).orderBy(DAY)


def whole_card():
    return by_day().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def calendar(cards: DataFrame, start: Column, end: Column) -> DataFrame:
    """Every day from start to end for every card; bounds may be columns of ``cards``."""
    days = F.sequence(start.cast("date"), end.cast("date"))
    return cards.filter(start.cast("date") <= end.cast("date")).select(KEY, F.explode(days).alias(DAY))


def reindex(series: DataFrame, days: DataFrame) -> DataFrame:
    """The series on exactly the given days; other days are dropped, gaps are NULL."""
    return days.join(series, [KEY, DAY], "left")


def dense(series: DataFrame) -> DataFrame:
    """The series on every day between each card's own first and last day."""
    spans = series.groupBy(KEY).agg(F.min(DAY).alias("_lo"), F.max(DAY).alias("_hi"))
    return reindex(series, calendar(spans, F.col("_lo"), F.col("_hi")))


def align(series: dict[str, DataFrame]) -> DataFrame:
    """Full outer join of many series on card and day in a single shuffle.

    ``series`` maps a column name to a frame ``cardname, date, <name>``.
    """
    names = list(series)
    long = [
        df.select(KEY, DAY, *[(F.col(n) if n == name else F.lit(None).cast("double")).alias(n) for n in names])
        for name, df in series.items()
    ]
    return reduce(DataFrame.unionByName, long).groupBy(KEY, DAY).agg(*[F.max(n).alias(n) for n in names])


def forward_fill(c: Column) -> Column:
    return F.last(c, ignorenulls=True).over(by_day().rowsBetween(W.unboundedPreceding, W.currentRow))


def fill(c: Column) -> Column:
    """Forward fill, then backward fill.

    After the forward fill only the head is open, and there the next known value
    is the card's first one: a single pass, not one search per row.
    """
    return F.coalesce(forward_fill(c), F.first(c, ignorenulls=True).over(whole_card()))


def zero_fill(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def lag_days(c: Column, days: int) -> Column:
    """Value ``days`` rows earlier; on a dense calendar that is days."""
    return F.lag(c, days).over(by_day())


def lag_join(series: DataFrame, columns: list[str], days: int, suffix: str = "_lag") -> DataFrame:
    """Value ``days`` calendar days earlier for series with gaps."""
    moved = series.select(KEY, F.date_add(DAY, days).alias(DAY), *[F.col(c).alias(c + suffix) for c in columns])
    return series.join(moved, [KEY, DAY], "left")


def day_index() -> Column:
    """Days since the card's first row."""
    return F.datediff(F.col(DAY), F.min(DAY).over(W.partitionBy(KEY)))


def clip_from_first(series: DataFrame, other: DataFrame, other_day: str) -> DataFrame:
    """Rows on or after the card's first day in ``other``."""
    first = other.groupBy(KEY).agg(F.min(other_day).alias("_first"))
    return series.join(first, KEY).filter(F.col(DAY) >= F.col("_first")).drop("_first")


def ordered_values(c: str) -> Column:
    """Aggregate: the card's values by day. Bounded by the number of days."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(DAY).alias("d"), F.col(c).alias("v"))))
    return F.transform(pairs, lambda x: x["v"])


def between(start: str, end: str) -> Column:
    return F.col(DAY).between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def contiguous_prefix(days: DataFrame, last_stored: Column, day: str = "d") -> DataFrame:
    """Days after ``last_stored`` up to the first missing one.

    The first missing day is the smallest day after a known day that is itself
    unknown, so no window over all days is needed.
    """
    known = days.select(F.col(day)).distinct().filter(F.col(day) > last_stored)
    start = known.sparkSession.range(1).select(last_stored.alias(day))
    nxt = known.unionAll(start).select(F.date_add(day, 1).alias("_next"))
    gap = nxt.join(known, F.col("_next") == F.col(day), "left_anti").agg(F.min("_next").alias("_gap"))
    return known.filter(F.col(day) < gap.scalar())


def future_days(last: Column, horizon: int) -> Column:
    """Array of the ``horizon`` days after ``last``."""
    return F.sequence(F.date_add(last, 1), F.date_add(last, horizon))
