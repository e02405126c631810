"""Daily sale prices from a stream of sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.operators.names import only_names
from marketloom.operators.quantiles import avg_and_median
from marketloom.operators.sales import clean_sales
from marketloom.streaming.files import last_batch, read_batches, run_batches, write_batch

GROUP = ["cardname", "carddate"]


def follow_daily_prices(sales: DataFrame, names: DataFrame, out: str, checkpoint: str) -> None:
    """Count the new sales by value, then write average and median of every day they touch.

    A sale seen before (title, card, day and unit price) is dropped by the stream's
    own state. What a batch adds is kept as counts by card, day and unit price.
    Counts of all batches add up to the day's values whatever the cut into files,
    and median and average follow from them exactly, so no sale is read again: a
    run reads the counts of the months it touches. Late sales correct their day.
    A run that breaks off before days are set is made up for by the next one.
    """
    spark, counts = sales.sparkSession, f"{out}-counts"
    clean = only_names(clean_sales(sales), names).select("title", *GROUP, "unit")
    schema = T.StructType([*[clean.schema[c] for c in (*GROUP, "unit")], T.StructField("n", T.LongType()), T.StructField("month", T.StringType())])

    def handle(batch: DataFrame, batch_id: int) -> None:
        added = batch.groupBy(*GROUP, "unit").agg(F.count(F.lit(1)).alias("n"))
        by_month = added.withColumn("month", F.coalesce(F.date_format("carddate", "yyyy-MM"), F.lit("none")))
        write_batch(by_month.repartition("month"), counts, batch_id, "month")

    run_batches(clean.dropDuplicates(["title", *GROUP, "unit"]), handle, checkpoint)
    last, done = last_batch(spark, counts), last_batch(spark, out)
    if last <= done:
        return
    new = read_batches(spark, counts, schema, after=done)
    first, latest = new.agg(F.min("month"), F.max("month")).first()
    near = read_batches(spark, counts, schema).filter(F.col("month").between(first, latest))
    near = near.join(new.select("month").distinct(), "month", "left_semi")
    touched = near.join(new.select(*GROUP).distinct(), GROUP, "left_semi")
    write_batch(avg_and_median(touched, GROUP, "unit", weight="n"), out, last)


def daily_prices(spark: SparkSession, out: str) -> DataFrame:
    """Each day's prices as the last run that touched it has set them."""
    newest = F.max_by(F.struct("avge", "med"), "batch").alias("p")
    return spark.read.parquet(out).groupBy(*GROUP).agg(newest).select(*GROUP, "p.avge", "p.med")
