"""Sinks: write to the shared folder, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom import sinks
from marketloom.operators import digital, shares
from marketloom.plans import features
from marketloom.plans.queries_market import STORED_UNTIL, model_names, sale, universe
from marketloom.plans.queries_model import instances
from marketloom.plans.queries_series import frame, slopes, window
from marketloom.plans.registry import query
from marketloom.session import work_path
from marketloom.sources.tables import Market


def _back(m: Market, path: str) -> DataFrame:
    return m.spark.read.parquet(path)


@query("snk1_full_refresh", "SELECT cardname, carddate, avge, med FROM {sale}")
def snk1(m):
    path = work_path(m.spark, "refresh")
    # What the table held before is gone afterwards.
    sinks.refresh_version(universe(m), path)
    sinks.refresh_version(sale(m), path)
    return sinks.read_version(m.spark, path)


@query("snk2_ctas", "SELECT id, card_id, date, price, cardname, cardset FROM {priced_versions}")
def snk2(m):
    table = f"priced_{uuid.uuid4().hex}"
    priced = digital.priced_versions(m["card_prices"], m["card_defs"], universe(m))
    sinks.create_as(priced, table, work_path(m.spark, "ctas"))
    return m.spark.table(table)


@query("snk3_append_batch", "SELECT id, card_id, date, price FROM {card_prices}")
def snk3(m):
    path = work_path(m.spark, "append")
    prices = m["card_prices"]
    sinks.full_refresh(prices.filter(F.col("date") <= F.lit(STORED_UNTIL).cast("date")), path)
    sinks.append_new(prices, path, ["card_id", "date"])
    return _back(m, path)


@query("snk4_replace_rank", "SELECT row_number() OVER (ORDER BY slope, cardname) AS id, cardname FROM {slopes}")
def snk4(m):
    path = work_path(m.spark, "slopes")
    sinks.replace_ranked(slopes(m), path)
    return sinks.read_version(m.spark, path).select("id", "cardname")


@query("snk5_delete_where", "SELECT cardname, entrydate, cardquant, tourntitle FROM {modern_decks} WHERE tourntitle NOT ILIKE 't3%'")
def snk5(m):
    source, target = work_path(m.spark, "decks"), work_path(m.spark, "decks")
    sinks.full_refresh(m.decks("modern"), source)
    sinks.delete_like(m.spark, source, target, "t3%")
    return _back(m, target)


@query(
    "snk6_json_lines",
    """SELECT category, CAST(hi - DATE '1995-02-01' + 1 AS INT) AS n_target FROM {model_names} CROSS JOIN {span}""",
)
def snk6(m):
    path = work_path(m.spark, "test-set")
    sinks.json_lines(features.documents(instances(m, test=True)), path)
    docs = m.spark.read.schema("target array<string>, cat array<int>").json(path)
    return docs.select(F.col("cat")[0].alias("category"), F.size("target").alias("n_target"))


@query(
    "snk7_put_if_absent",
    """SELECT 'kept' AS outcome, entrydate, SUM(cardquant) AS aggcount FROM {pioneer_decks} GROUP BY entrydate
       UNION ALL SELECT 'replaced', entrydate, SUM(cardquant) FROM {modern_decks} GROUP BY entrydate""",
)
def snk7(m):
    old, new = shares.day_total(m.decks("pioneer")), shares.day_total(m.decks("modern"))
    results = []
    for outcome, override in (("kept", False), ("replaced", True)):
        path = work_path(m.spark, "put")
        sinks.put(old, path)
        sinks.put(new, path, override)
        results.append(_back(m, path).select(F.lit(outcome).alias("outcome"), "entrydate", "aggcount"))
    return results[0].unionByName(results[1])


@query(
    "snk8_series_snapshot",
    """SELECT n.category, n.cardname, COUNT(*) FILTER (WHERE f.date >= DATE '1995-02-01') AS n_target, COUNT(*) AS n_feature
       FROM {frame} f JOIN {model_names} n ON n.cardname=f.cardname CROSS JOIN {span} WHERE f.date BETWEEN DATE '1995-02-01' - 7 AND hi
       GROUP BY n.category, n.cardname""",
)
def snk8(m):
    path = work_path(m.spark, "series")
    sinks.series_snapshot(features.serving_series(frame(m), features.categories(model_names(m)), window(m)), path)
    return _back(m, path).select(
        "category", "cardname", F.size("target").alias("n_target"), F.size(F.col("dynamic_feat")[0]).alias("n_feature")
    )


@query("snk9_registry_snapshot", "SELECT category, cardname, DATE '2001-11-04' AS run_day FROM {model_names}")
def snk9(m):
    path = work_path(m.spark, "registry")
    sinks.registry_snapshot(features.categories(model_names(m)), path, "2001-11-04 06:30:00")
    return _back(m, path).select("category", "cardname", F.col("carddate").cast("date").alias("run_day"))
