"""The ingest jobs from end to end: from pages and files as they come to the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions import tagger
from marketloom.operators import names
from marketloom.plans.queries_ingest import FIRST_PRICE, SHIPPING, page_item
from marketloom.plans.queries_market import AS_OF, SET_HITS, SINCE_SET, STORED_UNTIL, sets_per_card
from marketloom.plans.queries_tagger import first_word, has_word, sql_text
from marketloom.plans.registry import query
from marketloom.session import stored, work_path
from marketloom.sources.tables import Market
from marketloom.streaming import ingest
from marketloom.streaming.files import file_stream

PART = 25  # items of one page
BATCHES = 3  # batches the input is cut into
FILE_ITEMS = 250_000  # items of one file of pages, about

# --- sales ---------------------------------------------------------------------------

#: What an earlier run has stored: a month of sales, none of one set of cards.
STORED_SALES = f"""
    SELECT cardname, price, carddate, isfoil, saletype, CAST(cardquantity AS INT) AS cardquantity, cardspecial, cardlanguage,
      CAST(NULL AS VARCHAR(9)) AS cardcondition, title, possiblybad, FALSE AS isbanned, shipping, cardset,
      CAST(NULL AS VARCHAR(9)) AS rarity, lotis, isboosterbox, isgraded, iscommanderdeck, istoken, isemblem
    FROM {{transactions}}
    WHERE carddate BETWEEN DATE '{STORED_UNTIL}' - 30 AND DATE '{STORED_UNTIL}' AND cardname NOT LIKE 'new %'"""


def search_pages(m: Market) -> DataFrame:
    """Result pages of every card's search, some of them delivered twice."""
    title = "CASE WHEN title IS NULL THEN '<i></i>' ELSE title END"
    price = FIRST_PRICE.replace("l_linenumber", "line").replace("l_extendedprice", "amount")
    shipping = SHIPPING.replace("l_linenumber", "line").replace("l_quantity", "pieces")
    shop = page_item(title="'Shop on us'", day="DATE '2001-01-01'", price="'$1'", shipping="''")
    item = page_item(title=title, day="carddate", price=price, shipping=shipping)
    pages = m.derive(
        f"""SELECT search_id, cardname, part, concat('<ul>',{shop},array_join(transform(array_sort(items),x -> x.html),''),'</ul>') AS html
            FROM (SELECT search_id, cardname, CAST(place DIV {PART} AS INT) AS part, collect_list(struct(place, {item} AS html)) AS items
                  FROM {{search_items}} GROUP BY search_id, cardname, place DIV {PART})"""
    )
    fetched = F.to_timestamp(F.lit(AS_OF)) + F.make_dt_interval(mins="part")
    copies = F.sequence(F.lit(0), F.when(F.col("search_id") % 5 == 0, 1).otherwise(0))
    pages = pages.withColumns({"fetched": fetched, "copy": F.explode(copies)})
    return pages.withColumn("fetched", F.col("fetched") + F.make_dt_interval(mins="copy"))


def files_per_batch(m: Market, batches: int) -> int:
    """Files of a batch: as many as keep a file, and the task that writes it, the same size for any number of sales."""
    return max(1, round(m["lineitem"].count() / (FILE_ITEMS * batches)))


def stored_sales(m: Market, batches: int = BATCHES) -> DataFrame:
    """All sales after a run over the pages, in ``batches`` batches, that goes on from an earlier run's."""
    pages, out, checkpoint = (work_path(m.spark, f"sales-{x}") for x in ("pages", "out", "checkpoint"))
    files = files_per_batch(m, batches)
    search_pages(m).repartition(batches * files, "search_id", "part", "copy").drop("copy").write.parquet(pages)
    earlier = m.derive(STORED_SALES).to(ingest.T.StructType.fromDDL(ingest.SALE))
    earlier.write.parquet(f"{out}/batch=-1")
    stream = file_stream(m.spark, pages, m.spark.read.parquet(pages).schema, files_per_batch=files)
    codes = names.sets_since(m["sets"], SINCE_SET)
    ingest.ingest_sale_pages(stream, sets_per_card(m), m["cards"], codes, out, checkpoint, AS_OF)
    return m.spark.read.parquet(out).drop("batch")


_QUANTITIES = [(str(n), p.format(n=n)) for n in range(tagger.LARGEST_QUANTITY, 0, -1) for p in tagger.QUANTITY_PATTERNS]
_FOUND = f"""
    SELECT s.*, lower(s.title) AS t, lower(s.cardname) AS n, k.last,
      COALESCE(k.last + 1, DATE '{AS_OF}' - 100) AS lo, CASE WHEN k.last IS NULL THEN 100 ELSE 10 END AS slack
    FROM {{search_items}} s LEFT JOIN (SELECT cardname, MAX(carddate) AS last FROM ({STORED_SALES}) e GROUP BY cardname) k
      ON k.cardname=s.cardname"""


@query(
    "e5_sales_ingest",
    f"""SELECT * FROM ({STORED_SALES}) e UNION ALL
        SELECT f.cardname, CASE WHEN line IN (6,7) THEN NULL ELSE amount END AS price, carddate,
          {has_word('foil', True)} AS isfoil,
          CASE line WHEN 1 THEN 'strikethrough italic' WHEN 2 THEN 'italic' WHEN 3 THEN 'BO accepted' WHEN 6 THEN NULL
            ELSE 'normal' END AS saletype,
          {first_word(_QUANTITIES, False, "CASE WHEN contains(t,'playset') THEN 4 END")} AS cardquantity,
          {first_word([(sql_text(w), w) for w in tagger.SPECIAL_WORDS], True)} AS cardspecial,
          {first_word([(sql_text(w), w) for w in tagger.LANGUAGES], False)} AS cardlanguage,
          {first_word([(sql_text(w), w) for w in tagger.CONDITIONS], False)} AS cardcondition,
          f.title, FALSE AS possiblybad, FALSE AS isbanned, CASE WHEN line=3 OR line%2=0 THEN 0 ELSE pieces END AS shipping,
          b.cardset,
          CASE WHEN EXISTS (SELECT 1 FROM {{cards}} c WHERE c.name=f.cardname AND c.rarity='rare'
            AND c.setcode IN (SELECT code FROM {{recent_sets}})) THEN 'rare' ELSE 'mythic' END AS rarity,
          {' OR '.join(has_word(w, True) for w in tagger.LOT_WORDS).join('()')} AS lotis,
          (contains(t,'booster box') OR contains(t,'boosterbox')) AS isboosterbox,
          CASE WHEN {' OR '.join(has_word(w, True, '') for w in tagger.GRADE_WORDS)} THEN TRUE END AS isgraded,
          contains(t,'commander deck') AS iscommanderdeck, {has_word('token', True)} AS istoken, {has_word('emblem', True)} AS isemblem
        FROM ({_FOUND}) f LEFT JOIN (
          SELECT search_id, MIN(place) AS stop FROM ({_FOUND}) g WHERE carddate < lo AND carddate + slack >= lo GROUP BY search_id) e
          ON e.search_id=f.search_id
        LEFT JOIN (
          SELECT listing_id, title, cardname, code AS cardset FROM (
            SELECT *, row_number() OVER (PARTITION BY listing_id, title, cardname
              ORDER BY kind, length(CASE kind WHEN 0 THEN mcmname WHEN 1 THEN code ELSE name END) DESC, code) AS rn
            FROM ({SET_HITS}) h WHERE kind IS NOT NULL) r WHERE rn=1) b
          ON b.listing_id=f.listing_id AND b.title=f.title AND b.cardname=f.cardname
        WHERE (e.stop IS NULL OR f.place < e.stop) AND carddate BETWEEN lo AND DATE '{AS_OF}' - 1 AND contains(t,n)""",
)
def e5_sales(m):
    return stored_sales(m)


# --- tournaments ---------------------------------------------------------------------

SCANS = ("2001-07-01", "2001-07-05", "2001-07-10")
#: One row per line of a deck; a deck is what one supplier has in an event.
_ENTRIES = """
    SELECT p_name AS cardname, CAST(l_shipdate AS DATE) AS entrydate, CAST(l_quantity AS INT) AS cardquant, l_suppkey AS player,
      concat(CASE WHEN l_suppkey%7=3 THEN '(T' ELSE 'T' END, CAST(l_suppkey%7 AS VARCHAR(9)), CASE WHEN l_suppkey%7=3 THEN ')' ELSE '' END) AS tourntitle
    FROM {lineitem} JOIN {part} ON l_partkey=p_partkey WHERE l_returnflag='A'"""
_SEEN = f"""entrydate BETWEEN DATE '{SCANS[0]}' - {ingest.RESCAN_DAYS} AND DATE '{SCANS[-1]}'"""
#: What an earlier run has stored, with counts of its own.
STORED_ENTRIES = f"""
    SELECT cardname, entrydate, CAST(99 AS BIGINT) AS cardquant, tourntitle FROM ({_ENTRIES}) e
    WHERE entrydate BETWEEN DATE '{SCANS[0]}' - 12 AND DATE '{SCANS[0]}' - 6 AND tourntitle IN ('T0','T1','T2')"""


def tournament_pages(m: Market) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All events' search rows, tournament pages and deck pages."""
    entries = m.derive(_ENTRIES).filter(_SEEN)
    link = F.concat(F.lit("/tournament/"), F.date_format("entrydate", "yyyy-MM-dd"), F.lit("-"), F.translate("tourntitle", "()", "xx"))
    entries = entries.withColumn("url", link).withColumn("deck", F.concat(F.lit("/Deck/"), F.substring("url", 13, 99), F.lit("-"), F.col("player")))
    joined = lambda c: F.array_join(F.collect_list(c), "")
    row = F.concat(
        F.lit("<tr class='r'><td>"), F.date_format("entrydate", "yyyy-MM-dd"), F.lit('</td><td><a class="t" href="'), "url",
        F.lit('">'), "tourntitle", F.lit("</a></td></tr>"),
    )
    events = entries.select("entrydate", "tourntitle", "url").distinct().select("entrydate", row.alias("row"))
    anchor = F.concat(F.lit('<tr><td><a href="'), "deck", F.lit('">deck</a><a href="/player/1">p</a></td></tr>'))
    tournaments = (
        entries.select("url", "deck").distinct().groupBy("url")
        .agg(F.concat(F.lit('<a href="/deck/outside">no</a><table class="table-tournament">'), joined(anchor), F.lit("</table>")).alias("html"))
    )
    card = F.concat(
        F.lit('<tr><td class="text-right">'), F.col("cardquant").cast("string"), F.lit('</td><td><a rel="popover" href="/c">'), "cardname",
        F.lit('</a></td><td class="text-right">$ 1.50</td></tr>'),
    )
    decks = entries.groupBy(F.col("deck").alias("url")).agg(
        F.concat(F.lit('<div id="tab-paper"><table>'), joined(card), F.lit("</table></div>")).alias("html")
    )
    return events, tournaments, decks


def stored_tournaments(m: Market, at_once: bool = False) -> DataFrame:
    """All entries after three scans, each over the days of the one before again, that go on from an earlier run."""
    scans, out, checkpoint = (work_path(m.spark, f"tournaments-{x}") for x in ("scans", "out", "checkpoint"))
    m.derive(STORED_ENTRIES).to(ingest.T.StructType.fromDDL(ingest.ENTRY)).write.parquet(f"{out}/batch=-1")
    events, *linked = tournament_pages(m)
    events = stored(events, "events")
    tournaments, decks = (stored(pages, "pages") for pages in linked)
    head = F.lit('<table><tr><th>Date</th><th><a href="/sort">Name</a></th></tr>')
    for scan in SCANS:
        day = F.lit(scan).cast("date")
        shown = events.filter(F.col("entrydate").between(F.date_sub(day, ingest.RESCAN_DAYS), day))
        page = shown.groupBy(F.date_format("entrydate", "yyyyMMdd").cast("bigint").alias("page_id")).agg(
            F.concat(head, F.array_join(F.collect_list("row"), ""), F.lit("</table>")).alias("html")
        )
        page.coalesce(1).write.mode("append").parquet(scans)  # one after the other, as days go by
    stream = file_stream(m.spark, scans, page.schema, files_per_batch=None if at_once else 1)
    ingest.ingest_tournaments(stream, tournaments, decks, out, checkpoint)
    return m.spark.read.parquet(out).drop("batch")


@query(
    "e5_tournament_ingest",
    f"""SELECT cardname, entrydate, cardquant, tourntitle FROM ({STORED_ENTRIES}) s
        UNION ALL SELECT cardname, entrydate, SUM(cardquant) AS cardquant, tourntitle FROM ({_ENTRIES}) e
        WHERE {_SEEN} AND tourntitle NOT ILIKE '(%)'
          AND NOT EXISTS (SELECT 1 FROM ({STORED_ENTRIES}) k WHERE k.tourntitle=e.tourntitle AND k.entrydate=e.entrydate)
        GROUP BY cardname, entrydate, tourntitle""",
)
def e5_tournaments(m):
    return stored_tournaments(m)


# --- digital prices ------------------------------------------------------------------

LATE_DAY, MISSING_DAY = "2001-08-05", "2001-10-01"
_DAY_PRICES = "SELECT card_id, date, MAX(price) AS price FROM {card_prices} GROUP BY card_id, date"
_STORED_CARDS = "SELECT card_id, cardname, foil, 'Stored' AS rarity, cardset FROM {card_defs} WHERE card_id%3=0"


def day_files(m: Market) -> DataFrame:
    """One document per day with the prices of all cards, named like the daily files."""
    entry = F.struct(F.col("card_id").cast("string").alias("key"), F.col("price").alias("value"))
    by_day = m.derive(_DAY_PRICES).groupBy("date").agg(F.map_from_entries(F.collect_list(entry)).alias("prices"))
    name = F.concat(F.lit("price-history-"), F.date_format("date", "yyyy-MM-dd"), F.lit(".txt"))
    return by_day.select(name.alias("file_name"), F.to_json("prices").alias("value"), "date")


def definition_files(m: Market) -> DataFrame:
    """A few documents with the definitions of many cards each."""
    value = F.struct(F.col("cardname").alias("name"), F.col("foil").cast("int").alias("foil"), "rarity", "cardset")
    entry = F.struct(F.col("card_id").cast("string").alias("key"), value.alias("value"))
    grouped = m["card_defs"].groupBy("cardset").agg(F.map_from_entries(F.collect_list(entry)).alias("cards"))
    return grouped.select(F.to_json("cards").alias("value"))


def stored_digital(m: Market) -> tuple[DataFrame, DataFrame]:
    """Definitions and prices after two runs; the second finds a day the first one missed."""
    cards, prices = work_path(m.spark, "digital-cards"), work_path(m.spark, "digital-prices")
    m.derive(_STORED_CARDS).to(ingest.T.StructType.fromDDL(ingest.DEFINITION_ROW)).write.parquet(f"{cards}/batch=0")
    earlier = m.derive(_DAY_PRICES).filter(F.col("date") <= F.lit(STORED_UNTIL).cast("date"))
    earlier.to(ingest.T.StructType.fromDDL(ingest.PRICE_ROW)).write.parquet(f"{prices}/batch=0")
    files, definitions = stored(day_files(m), "day-files"), stored(definition_files(m), "definition-files")
    for missing in ((LATE_DAY, MISSING_DAY), (MISSING_DAY,)):
        there = files.filter(~F.col("date").isin(*[F.lit(d).cast("date") for d in missing])).drop("date")
        ingest.ingest_digital(definitions, there, cards, prices)
    return m.spark.read.parquet(cards).drop("batch"), m.spark.read.parquet(prices).drop("batch")


@query(
    "e5_digital_ingest",
    f"""SELECT p.card_id, p.date, p.price, d.cardname, d.foil, CASE WHEN d.card_id%3=0 THEN 'Stored' ELSE d.rarity END AS rarity, d.cardset
        FROM ({_DAY_PRICES}) p JOIN {{card_defs}} d ON d.card_id=p.card_id
        WHERE p.date < (
          SELECT MIN(day) FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '{STORED_UNTIL}' + INTERVAL 1 DAY, TIMESTAMP '2100-01-01', INTERVAL 1 DAY)) AS DATE) AS day) c
          WHERE day = DATE '{MISSING_DAY}' OR day NOT IN (SELECT date FROM {{card_prices}} WHERE date IS NOT NULL))""",
)
def e5_digital(m):
    cards, prices = stored_digital(m)
    return prices.join(cards, "card_id")
