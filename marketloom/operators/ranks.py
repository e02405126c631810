"""Positions in a global order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.session import stored


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based position of each row in ``order`` (which should break all ties).

    Rows are range-partitioned in that order and written once, so that both
    passes see the same partitions: one pass counts rows per partition, the
    other numbers rows inside a partition and adds what lies before it. The
    offsets have one row per partition.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(partitions, *order).withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged, "rank")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    local = ranged.withColumn("_local", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return local.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_before") + F.col("_local")).cast("bigint").alias(name)
    )


def last_rows(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key in ``order``.

    Spark cuts each map task's share to ``n`` rows per key before the shuffle
    (WindowGroupLimit), so a hot key ships only ``n`` rows per task.
    """
    position = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_rn", position).filter(F.col("_rn") <= n).drop("_rn")
