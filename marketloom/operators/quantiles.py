"""Exact average and median per group, whatever a group's size.

The middle ranks are found by counting, not by sorting a group: values are
counted by bucket, the buckets that hold the middle ranks are kept, and their
values are counted again in finer buckets. Counts are combined inside each task
and spread over the cluster by group and bucket, so no group stands in one
buffer; what a group sends to one task is at most one row per bucket.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# First buckets: so many to a factor e, below about a million in all. Each later
# round cuts the stretch between a bucket's least and greatest value into PARTS.
# 1 / PER_E of a value spans less than 2^44 doubles, so two such rounds part all
# values that differ.
PER_E = 369
PARTS = 1 << 22
ROUNDS = 3
_BEYOND = 1_000_000


def _first_bucket(v: Column) -> Column:
    """A number that does not fall as ``v`` grows; infinities, NaN and 0 have their own."""
    size = F.floor(F.ln(F.abs(v)) * PER_E) + F.lit(_BEYOND // 2)
    return (
        F.when(v.isNull() | (v == 0), F.lit(0).cast("bigint"))
        .when(F.isnan(v), F.lit(2 * _BEYOND).cast("bigint"))
        .when(F.abs(v) == float("inf"), F.when(v > 0, _BEYOND).otherwise(-_BEYOND).cast("bigint"))
        .otherwise(F.when(v > 0, size).otherwise(-size))
    )


def _fine_bucket(v: Column, lo: Column, hi: Column) -> Column:
    return F.floor((v - lo) / (hi - lo) * PARTS)


def _counted(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.sum("_w").alias("_size"), F.sum(F.col("_v") * F.col("_w")).alias("_sum"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )


def _holding(buckets: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """Buckets that hold one of the ranks ``_lower`` and ``_upper``, which become ranks inside the bucket, else null."""
    upto = F.sum("_size").over(W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, 0))
    placed = buckets.withColumn("_before", upto - F.col("_size"))

    def inside(rank: str) -> Column:
        rank_ = F.col(rank) - F.col("_before")
        return F.when((rank_ > 0) & (rank_ <= F.col("_size")), rank_)

    placed = placed.withColumns({"_lower": inside("_lower"), "_upper": inside("_upper")}).drop("_before")
    return placed.filter(F.coalesce("_lower", "_upper").isNotNull() | (F.col("_n") == 0))


def avg_and_median(
    df: DataFrame,
    keys: list[str],
    value: str,
    avg_name: str = "avge",
    median_name: str = "med",
    weight: str | None = None,
    level: float = 0.5,
) -> DataFrame:
    """``keys, avg, median`` with the exact, interpolated median; ``weight`` tells how often a row counts.

    With another ``level`` that quantile takes the median's place.

    Null values do not count; a group of nulls has a null average and median. Null
    keys are keys like any other.
    """
    times = F.col(weight) if weight else F.lit(1)
    v = F.col(value).cast("double")
    rows = df.select(*keys, (v + F.lit(0.0)).alias("_v"), F.when(v.isNotNull(), times).otherwise(0).cast("bigint").alias("_w"))
    rows = rows.withColumn("_b", _first_bucket(F.col("_v")))

    whole = W.partitionBy(*keys)
    buckets = _counted(rows, [*keys, "_b"]).withColumns(
        {"_n": F.sum("_size").over(whole), avg_name: F.try_divide(F.sum("_sum").over(whole), F.sum("_size").over(whole))}
    )
    n = F.col("_n")
    # How far the quantile lies past the lower of its two neighbours; ranks count from 1.
    place = (n - 1) * F.lit(level)
    ranked = buckets.withColumns({"_lower": F.floor(place) + 1, "_upper": F.ceil(place) + 1})
    held = _holding(ranked, keys, "_b")
    one_value = F.col("_lo").eqNullSafe(F.col("_hi"))
    carried = ["_n", avg_name, "_lower", "_upper", "_lo", "_hi"]
    done = [held.filter(one_value).select(*keys, *carried)]
    for _ in range(ROUNDS - 1):
        open_ = held.filter(~one_value)
        open_ = open_.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("_in"), *carried)
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        within = [F.col("_b") == F.col("_in"), F.col("_v") >= F.col("_lo"), F.col("_v") <= F.col("_hi")]
        part = _fine_bucket(F.col("_v"), F.col("_lo"), F.col("_hi"))
        near = rows.join(open_, reduce(and_, same + within)).withColumn("_part", part).withColumnsRenamed({"_lo": "_from", "_hi": "_to"})
        kept = ["_n", avg_name, "_lower", "_upper"]
        # Two open buckets of a group are told apart by where they begin.
        group = [*keys, "_b", "_from"]
        fine = _counted(near, [*group, "_part", *kept])
        held = _holding(fine, group, "_part")
        done.append(held.filter(one_value).select(*keys, *carried))
    found = reduce(DataFrame.unionByName, done)
    at = lambda rank: F.max(F.when(F.col(rank).isNotNull(), F.col("_lo")))
    place = (F.first("_n") - 1) * F.lit(level)
    past = place - F.floor(place)
    between = at("_lower") * (1 - past) + F.when(past > 0, at("_upper") * past).otherwise(0.0)
    return found.groupBy(*keys).agg(F.first(avg_name).alias(avg_name), between.alias(median_name))
