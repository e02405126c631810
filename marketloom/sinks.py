"""Ways to store a result."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketloom.operators.incremental import new_rows
from marketloom.operators.momentum import ranked_slopes
from marketloom.operators.shares import without_titles_like


def full_refresh(df: DataFrame, path: str) -> None:
    """Replace the whole table. ``df`` must not read from ``path``."""
    df.write.mode("overwrite").parquet(path)


_COMMITS = "version bigint, through bigint"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_COMMITS).parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMITS)


def committed(spark: SparkSession, path: str) -> tuple[int, int]:
    """The current version of the table at ``path`` and the number it was written with; -1 each if there is none."""
    newest = _commits(spark, path).agg(F.max(F.struct("version", "through")).alias("c")).first().c
    return (newest.version, newest.through) if newest else (-1, -1)


def read_version(spark: SparkSession, path: str, schema: StructType | str | None = None, version: int | None = None) -> DataFrame:
    """The current version of a table, or the given one; no rows, if ``schema`` is known, where none is committed."""
    version = committed(spark, path)[0] if version is None else version
    if version < 0 and schema is not None:
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/version={version}")


def refresh_version(df: DataFrame, path: str, through: int = -1) -> int:
    """Replace the table by a new version, which becomes current when it is whole.

    The version has a folder of its own, and one small row, written last, makes it
    the current one. A reader holds on to the version it has begun with, a refresh
    that breaks off leaves the former one current, and ``df`` may read the table it
    replaces. One writer at a time; ``through`` is kept with the version.
    """
    spark = df.sparkSession
    version = committed(spark, path)[0] + 1
    full_refresh(df, f"{path}/version={version}")
    spark.createDataFrame([(version, through)], _COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return version


def create_as(df: DataFrame, table: str, path: str) -> None:
    """Drop and create a catalog table from a query.

    The rows are written as a new version below ``path`` first; the table is then
    set to it, so it is never seen half written.
    """
    spark, version = df.sparkSession, refresh_version(df, path)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.catalog.createTable(table, path=f"{path}/version={version}", source="parquet")


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose key the table does not hold yet."""
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    new_rows(df, stored, keys).write.mode("append").parquet(path)


def replace_ranked(slopes: DataFrame, path: str) -> None:
    """Replace the slope table; ids follow rising slope. Pages read meanwhile see one version throughout."""
    refresh_version(ranked_slopes(slopes), path)


def delete_like(spark: SparkSession, path: str, target: str, pattern: str = "(%)") -> None:
    """Rewrite a deck table without the titles that match.

    The rest goes to ``target``: files are not overwritten while being read.
    """
    full_refresh(without_titles_like(spark.read.parquet(path), pattern), target)


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def put(df: DataFrame, path: str, override: bool = False) -> None:
    """Write unless something is there already; with ``override`` replace it."""
    df.write.mode("overwrite" if override else "ignore").parquet(path)


def series_snapshot(df: DataFrame, path: str) -> None:
    """Per card: name, category, features and target as arrays."""
    full_refresh(df.select("cardname", "category", "dynamic_feat", "target"), path)


def registry_snapshot(names: DataFrame, path: str, run_ts: str) -> None:
    """The cards a model run covers, with the time of the run."""
    stamped = names.select("category", "cardname", F.lit(run_ts).cast("timestamp").alias("carddate"))
    full_refresh(stamped, path)
