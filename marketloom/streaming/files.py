"""Helpers shared by the streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Stream a parquet table kept as one file or as a folder of files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A plain file path is not accepted; this pattern matches that path alone.
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_batches(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
) -> None:
    """Process everything available now, batch by batch, then stop."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def batch_path(out: str, batch_id: int) -> str:
    """Each batch owns a folder, so a replayed batch overwrites itself."""
    return f"{out}/batch={batch_id}"


def write_batch(df: DataFrame, out: str, batch_id: int, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(batch_path(out, batch_id))


def _numbered(spark: SparkSession, path: str, schema: StructType, number: str) -> DataFrame:
    """The rows below ``path`` with the number of their folder; none if nothing was written yet."""
    full = StructType([*schema.fields, StructField(number, LongType())])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def last_batch(spark: SparkSession, out: str) -> int:
    """Number of the last batch that holds rows, -1 if none does."""
    last = _numbered(spark, out, StructType([]), "batch").agg(F.max("batch")).first()[0]
    return -1 if last is None else last


def read_batches(spark: SparkSession, out: str, schema: StructType, after: int | None = None) -> DataFrame:
    """Rows of the batches written so far, or of those after number ``after``."""
    df = _numbered(spark, out, schema, "batch")
    if after is not None:
        df = df.filter(df["batch"] > after)
    return df.select(*schema.names)


def run_with_known(
    spark: SparkSession,
    out: str,
    schema: StructType,
    fold: Callable[[DataFrame], DataFrame],
    run: Callable[[DataFrame], None],
) -> None:
    """``run(known)``, where ``known`` is what finished runs left: their rows, folded.

    It is fixed for all batches of a run, so a result does not depend on how the
    input is cut into files. It is kept as a small table per run and carried on
    from run to run; a run that breaks off starts again from the same table. Rows
    put into the store from elsewhere, as batch -1, are known from the start.
    """
    kept = f"{out}-known"
    tables = _numbered(spark, kept, schema, "through")
    through = tables.agg(F.max("through")).first()[0]
    if through is None:
        through, seeded = -1, _numbered(spark, out, schema, "batch").filter("batch < 0")
        known = fold(seeded.select(*schema.names))
    else:
        known = tables.filter(F.col("through") == through).select(*schema.names)
    run(known)
    last = last_batch(spark, out)
    if last > through:
        fold(known.unionByName(read_batches(spark, out, schema, after=through))).write.mode("overwrite").parquet(
            f"{kept}/through={last}"
        )
