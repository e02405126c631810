"""Subscription state kept up to date from a stream of payment events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom import sinks
from marketloom.operators import members
from marketloom.streaming.files import last_batch, read_batches, run_batches, write_batch


def _changes(out: str) -> str:
    return f"{out}-changes"


def follow(events: DataFrame, out: str, checkpoint: str) -> None:
    """Fold events per customer; each batch writes the customers it changed, a run the state.

    The fold is a maximum by event time, so it is combined inside each task
    before the shuffle, late events need no special case, and the state holds
    two small records per customer. A run ends with a new version of the state:
    the former one with the changes since. It lies in the order of the period's
    end, so what has run out by a day is read from a few files.
    """
    folded = members.latest(members.effects(events))
    run_batches(folded, lambda batch, batch_id: write_batch(batch, _changes(out), batch_id), checkpoint, mode="update")
    spark, schema = events.sparkSession, folded.schema
    last = last_batch(spark, _changes(out))
    version, through = sinks.committed(spark, out)
    if last <= through:
        return
    before = sinks.read_version(spark, out, _state_schema(schema), version).select(*schema.names)
    after = members.latest(before.unionByName(read_batches(spark, _changes(out), schema, after=through)))
    ends = F.col("period_set.period_end")
    sinks.refresh_version(after.withColumn("period_end", ends).repartitionByRange("period_end").sortWithinPartitions("period_end"), out, last)


def _state_schema(folded):
    period = folded["period_set"].dataType["period_end"]
    return type(folded)([*folded.fields, period])


def _kept(spark: SparkSession, out: str, events: DataFrame) -> DataFrame:
    return sinks.read_version(spark, out, _state_schema(members.latest(members.effects(events)).schema))


def current(spark: SparkSession, out: str, events: DataFrame) -> DataFrame:
    """State after the last run, whatever the number of its batches. ``events`` gives the schema the stream had."""
    return members.state(_kept(spark, out, events))


def expired(spark: SparkSession, out: str, events: DataFrame, since: int, as_of: int) -> DataFrame:
    """Customers whose role ends between two looks: their period ended in [``since``, ``as_of``).

    The bounds reach the scan, which leaves out files of other periods.
    """
    due = _kept(spark, out, events).filter((F.col("period_end") >= since) & (F.col("period_end") < as_of))
    return members.expire(members.state(due).filter(F.col("role") == members.SUBSCRIBED), as_of)
