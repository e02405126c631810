"""Stored tables and the domain tables derived from them."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import stored, tune
from marketloom.sources.views import STORED, VIEWS, references

DECKS = ("pioneer", "modern", "standard")


def table_scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Read a parquet table; the projection reaches the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def jdbc_scan(
    spark: SparkSession,
    url: str,
    table: str,
    columns: list[str],
    partition_column: str,
    bounds: tuple[str, str],
    partitions: int,
) -> DataFrame:
    """Read a database table in parallel ranges of ``partition_column``."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=partition_column,
            lowerBound=bounds[0],
            upperBound=bounds[1],
            numPartitions=partitions,
        )
        .load()
        .select(*columns)
    )


class Market:
    """Access by name to the tables below one folder: ``market["transactions"]``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = tune(spark)
        self.root = root.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            if name in STORED:
                self._tables[name] = table_scan(self.spark, self.path(name))
            else:
                self._tables[name] = self.derive(VIEWS[name])
        return self._tables[name]

    def derive(self, template: str, **given: DataFrame) -> DataFrame:
        """Run a view template over this market's tables."""
        frames = {n: given.get(n) if n in given else self[n] for n in references(template)}
        return self.spark.sql(template, **frames)

    @cached_property
    def last_day(self) -> str | None:
        """The last day of the stored sales, where calendars end; one aggregate over one column."""
        day = self["lineitem"].agg(F.max(F.col("l_shipdate").cast("date"))).first()[0]
        return day and day.isoformat()

    def spread(self, name: str) -> DataFrame:
        """A stored table for heavy work per row: one partition per core at least.

        A file with fewer row groups than cores would leave cores idle; a large
        table has more of them and is read as it is.
        """
        df, cores = self[name], self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    @property
    def listings(self) -> DataFrame:
        """Listing titles, for matching words against each of them."""
        return self.derive(VIEWS["listings"], lineitem=self.spread("lineitem"))

    def once(self, label: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A small result that several parts of a job look up, written once.

        Read back from files its true size is known, so Spark can broadcast it
        where it is small and need not shuffle the large side to find out.
        """
        if label not in self._tables:
            self._tables[label] = stored(make(), label)
        return self._tables[label]

    def decks(self, game_format: str) -> DataFrame:
        return self[f"{game_format}_decks"]
