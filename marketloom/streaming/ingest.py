"""Incremental ingest: sales, digital prices, tournament entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import DateType, StringType, StructField, StructType

from marketloom.functions import tagger
from marketloom.operators.incremental import in_range, is_stop, new_rows, with_bounds
from marketloom.operators.setmatch import add_rarity, add_set, rare_cards
from marketloom.operators.shares import event_counts, without_titles_like
from marketloom.session import stored
from marketloom.sources import markup
from marketloom.operators.series import contiguous_prefix
from marketloom.sources.documents import card_definitions, card_price_rows, price_day
from marketloom.streaming.files import last_batch, read_batches, run_batches, run_with_known, write_batch

RESCAN_DAYS = 14


def ingest_sales(
    listings: DataFrame,
    out: str,
    checkpoint: str,
    as_of: str,
    derive: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> None:
    """Pick the new listings in their card's wanted days, tag and append them.

    The high-water mark is one per card, which a stream's single watermark
    cannot express. It is what earlier runs stored, the same for all batches.
    ``derive`` turns a batch of the source into ``title, cardname, carddate, ...``.
    """

    schema = StructType([StructField("cardname", StringType()), StructField("carddate", DateType())])

    def mark(rows: DataFrame) -> DataFrame:
        return rows.groupBy("cardname").agg(F.max("carddate").alias("carddate"))

    def run(known: DataFrame) -> None:
        def handle(batch: DataFrame, batch_id: int) -> None:
            write_batch(tagger.tag(in_range(derive(batch), known, as_of)), out, batch_id)

        run_batches(listings, handle, checkpoint)

    run_with_known(listings.sparkSession, out, schema, mark, run)


#: A stored sale.
SALE = (
    "cardname string, price double, carddate date, isfoil boolean, saletype string, cardquantity int, cardspecial string, "
    "cardlanguage string, cardcondition string, title string, possiblybad boolean, isbanned boolean, shipping double, "
    "cardset string, rarity string, lotis boolean, isboosterbox boolean, isgraded boolean, iscommanderdeck boolean, "
    "istoken boolean, isemblem boolean"
)
SEARCH = ["search_id", "cardname"]
LATEST_COPY = "1 day"


def ingest_sale_pages(
    pages: DataFrame,
    sets_per_card: DataFrame,
    cards: DataFrame,
    rare_codes: DataFrame,
    out: str,
    checkpoint: str,
    as_of: str,
) -> None:
    """From result pages ``search_id, cardname, part, fetched, html`` to stored sales (columns SALE).

    The pages of one search are parts in order, and may come in any order and in
    any cut into batches. A page that comes again within a day of its first copy
    (by ``fetched``) is dropped by the stream's own state. Each batch writes what
    it knows: its wanted rows, tagged, and per search the first place where the
    reading stops. Where a search ends is the smallest of all batches' stops, so
    it is settled once per run; a run that breaks off before is settled by the
    next one, under the same high-water marks.
    """
    spark = pages.sparkSession
    found, stops = f"{out}-found", f"{out}-stops"
    sale = T.StructType.fromDDL(SALE)
    place = T.StructField("place", T.StructType.fromDDL("part int, position int"))
    search = [T.StructField("search_id", pages.schema["search_id"].dataType)]
    mark = T.StructType([sale["cardname"], sale["carddate"]])
    sets, rare = stored(sets_per_card, "card-sets"), stored(rare_cards(cards, rare_codes), "rare")
    once = pages.withWatermark("fetched", LATEST_COPY).dropDuplicatesWithinWatermark(["search_id", "part"])

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("cardname").agg(F.max("carddate").alias("carddate"))

    def handle(batch: DataFrame, batch_id: int, known: DataFrame) -> None:
        items = markup.listing_items(batch.select(*SEARCH, "part", "html"))
        rows = with_bounds(markup.typed_items(items), known, as_of)
        rows = stored(rows.withColumn("place", F.struct("part", "position")), "sale-items")
        day, lo, hi = F.col("carddate"), F.col("_lo"), F.col("_hi")
        ends = rows.filter(is_stop(day, lo, F.col("_slack"))).groupBy("search_id").agg(F.min("place").alias("stop"))
        write_batch(ends, stops, batch_id)
        wanted = rows.filter((day >= lo) & (day <= hi) & F.col("title").isNotNull())
        tagged = add_rarity(add_set(tagger.tag(wanted), sets), rare)
        write_batch(tagged.select("search_id", "place", *sale.names).to(T.StructType([*search, place, *sale])), found, batch_id)

    def settle() -> None:
        last, done = last_batch(spark, found), last_batch(spark, out)
        if last <= done:
            return
        rows = read_batches(spark, found, T.StructType([*search, place, *sale]), after=done)
        stop = T.StructField("stop", place.dataType)
        ends = read_batches(spark, stops, T.StructType([*search, stop]), after=done)
        ends = ends.groupBy("search_id").agg(F.min("stop").alias("stop"))
        kept = rows.join(ends, "search_id", "left").filter(F.col("stop").isNull() | (F.col("place") < F.col("stop")))
        write_batch(kept.select(*sale.names), out, last)

    def run(known: DataFrame) -> None:
        run_batches(once, lambda batch, batch_id: handle(batch, batch_id, known), checkpoint)
        settle()

    run_with_known(spark, out, mark, newest, run)


def ingest_prices(documents: DataFrame, out: str, checkpoint: str) -> None:
    """Append the rows of each new price document; the checkpoint keeps what was read."""
    query = (
        card_price_rows(documents)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


ENTRY = "cardname string, entrydate date, cardquant bigint, tourntitle string"
EVENT = StructType([StructField("tourntitle", StringType()), StructField("entrydate", DateType())])


def _recent_events(rows: DataFrame) -> DataFrame:
    newest = rows.agg(F.max("entrydate")).scalar()
    return rows.filter(F.col("entrydate") >= F.date_sub(newest, RESCAN_DAYS)).distinct()


def ingest_entries(
    entries: DataFrame,
    out: str,
    checkpoint: str,
    derive: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> None:
    """Add up the cards of tournaments that earlier runs have not stored yet.

    Each scan covers the last days again. An event counts as known if a finished
    run stored its title and day; only days a scan can still show are looked up.
    An event in several files has rows in several batches: ``stored_entries``
    adds them up.
    """

    def run(known: DataFrame) -> None:
        def handle(batch: DataFrame, batch_id: int) -> None:
            write_batch(event_counts(derive(batch)).join(known, EVENT.names, "left_anti"), out, batch_id)

        run_batches(entries, handle, checkpoint)

    run_with_known(entries.sparkSession, out, EVENT, _recent_events, run)


def ingest_tournaments(results: DataFrame, tournaments: DataFrame, decks: DataFrame, out: str, checkpoint: str) -> None:
    """From search-result pages to the cards of new tournaments (columns ENTRY).

    ``results`` streams ``page_id, html`` of daily scans, each over the last
    RESCAN_DAYS days; ``tournaments`` and ``decks`` hold ``url, html`` of the pages
    the links lead to. A tournament page shown before is dropped by the stream's
    state, which forgets events once no scan can show them again. Events stored by
    earlier runs are skipped by title and day. Only pages of new events are parsed.
    Titles in brackets are not kept.
    """
    rows = markup.result_rows(results)
    dated = rows.withColumn("entrydate", F.col("entrydate").try_cast("date"))
    dated = dated.withColumn("day", F.col("entrydate").cast("timestamp")).withWatermark("day", f"{RESCAN_DAYS + 1} days")
    once = dated.dropDuplicatesWithinWatermark([*EVENT.names, "href"])

    def cards_of(events: DataFrame) -> DataFrame:
        pages = events.join(tournaments, F.col("href") == F.col("url")).select(*EVENT.names, "html")
        links = markup.deck_links(pages).withColumnRenamed("href", "deck")
        pages = links.join(decks, F.col("deck") == F.col("url")).select(*EVENT.names, "html")
        return event_counts(markup.deck_cards(pages))

    def run(known: DataFrame) -> None:
        def handle(batch: DataFrame, batch_id: int) -> None:
            fresh = without_titles_like(batch.select(*EVENT.names, "href").join(known, EVENT.names, "left_anti"))
            entries = cards_of(stored(fresh, "new-events"))
            write_batch(entries.select(*T.StructType.fromDDL(ENTRY).names).to(T.StructType.fromDDL(ENTRY)), out, batch_id)

        run_batches(once, handle, checkpoint)

    run_with_known(results.sparkSession, out, EVENT, _recent_events, run)


def stored_entries(spark: SparkSession, out: str) -> DataFrame:
    """The entries of all runs, one row per event and card."""
    return event_counts(spark.read.parquet(out))


DEFINITION_ROW = "card_id bigint, cardname string, foil boolean, rarity string, cardset string"
PRICE_ROW = "card_id bigint, date date, price double"


def ingest_digital(definitions: DataFrame, prices: DataFrame, out_definitions: str, out_prices: str) -> None:
    """Append new card definitions, and the price files from the last stored day to the first missing one.

    ``definitions`` has ``value`` and ``prices`` has ``file_name, value``: all
    documents that are there. The stored days say where to go on, so a file that
    fills a gap is read with those behind it by the next run, whenever it comes;
    documents of other days are not parsed. A run's rows are one batch, numbered
    by its first day, which a repeated run replaces. Nothing happens without a
    stored day to go on from, or if the day after it is missing.
    """
    spark = definitions.sparkSession
    definition, price = T.StructType.fromDDL(DEFINITION_ROW), T.StructType.fromDDL(PRICE_ROW)
    known = read_batches(spark, out_definitions, definition)
    fresh = new_rows(card_definitions(definitions), known, ["card_id"]).dropDuplicates(["card_id"])
    write_batch(fresh.select(*definition.names), out_definitions, last_batch(spark, out_definitions) + 1)

    dated = prices.withColumn("d", price_day(F.col("file_name")))
    last = read_batches(spark, out_prices, price).agg(F.max("date")).first()[0]
    days = stored(contiguous_prefix(dated, F.lit(last)), "price-days")
    first = days.agg(F.min("d")).first()[0]
    if first is not None:
        rows = card_price_rows(dated.join(days, "d", "left_semi"))
        write_batch(rows.select(*price.names), out_prices, first.toordinal())
