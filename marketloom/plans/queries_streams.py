"""Streaming jobs run over the stored tables until everything is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marketloom.operators import members
from marketloom.plans.queries_ingest import price_docs
from marketloom.plans.queries_market import AS_OF, EXPIRY, played
from marketloom.plans.registry import query
from marketloom.session import work_path
from marketloom.sources.tables import Market
from marketloom.sources.views import VIEWS
from marketloom.streaming import daily, ingest, membership
from marketloom.streaming.files import file_stream


def _stream(m: Market, table: str) -> DataFrame:
    return file_stream(m.spark, m.path(table), m[table].schema)


def _places(m: Market, label: str) -> tuple[str, str]:
    return work_path(m.spark, label), work_path(m.spark, f"{label}-checkpoint")


def _from_batch(m: Market, view: str, table: str = "lineitem"):
    """Derive a view from a batch of ``table`` and the stored other tables."""
    return lambda batch: Market(batch.sparkSession, m.root).derive(VIEWS[view], **{table: batch})


@query(
    "st1_incremental_sales",
    f"""SELECT listing_id, cardname, carddate, title FROM {{listings}}
        WHERE contains(lower(title),lower(cardname)) AND carddate BETWEEN DATE '{AS_OF}' - 100 AND DATE '{AS_OF}' - 1""",
)
def st1(m):
    out, checkpoint = _places(m, "sales")
    ingest.ingest_sales(_stream(m, "lineitem"), out, checkpoint, AS_OF, _from_batch(m, "listings"))
    return m.spark.read.parquet(out).select("listing_id", "cardname", "carddate", "title")


@query("st2_incremental_prices", "SELECT card_id, date, price FROM {card_prices}")
def st2(m):
    docs = work_path(m.spark, "price-docs")
    price_docs(m).write.parquet(docs)
    out, checkpoint = _places(m, "prices")
    ingest.ingest_prices(file_stream(m.spark, docs, m.spark.read.parquet(docs).schema), out, checkpoint)
    return m.spark.read.parquet(out)


@query(
    "st3_rolling_tournaments",
    "SELECT entrydate, tourntitle, cardname, SUM(cardquant) AS cardquant FROM {pioneer_decks} GROUP BY entrydate, tourntitle, cardname",
)
def st3(m):
    out, checkpoint = _places(m, "entries")
    ingest.ingest_entries(_stream(m, "lineitem"), out, checkpoint, _from_batch(m, "pioneer_decks"))
    return ingest.stored_entries(m.spark, out).select("entrydate", "tourntitle", "cardname", "cardquant")


@query("st4_stream_state", "SELECT customer, role, period_end FROM {members}")
def st4(m):
    return _followed(m)


@query(
    "st5_stream_expiry",
    f"SELECT customer, CASE WHEN period_end < {EXPIRY} THEN 'unsubscribed' ELSE role END AS role, period_end FROM {{members}}",
)
def st5(m):
    return members.expire(_followed(m), EXPIRY)


def _followed(m: Market) -> DataFrame:
    out, checkpoint = _places(m, "members")
    events = m.derive(VIEWS["sub_events"], events=_stream(m, "events"))
    membership.follow(events, out, checkpoint)
    return membership.current(m.spark, out, m["sub_events"])


@query(
    "st6_daily_price_stream",
    "SELECT cardname, carddate, avge, med FROM {sale}",
)
def st6(m):
    out, checkpoint = _places(m, "daily")
    sales = m.derive(VIEWS["transactions"], lineitem=_stream(m, "lineitem"))
    daily.follow_daily_prices(sales, played(m), out, checkpoint)
    return daily.daily_prices(m.spark, out)
