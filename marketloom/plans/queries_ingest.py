"""Sources: documents and pages written by Spark from the tables, then read like the real ones."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.plans.registry import query
from marketloom.sources import documents, files, markup
from marketloom.sources.tables import Market, table_scan
from marketloom.sources.views import VIEWS


@query("src1_table_scan", "SELECT p_partkey, p_name FROM {part}")
def src1(m):
    return table_scan(m.spark, m.path("part"), ["p_partkey", "p_name"])


# --- JSON --------------------------------------------------------------------------


def definition_docs(m: Market) -> DataFrame:
    """One ``{id: definition}`` document per card version."""
    entry = F.struct(
        F.col("cardname").alias("name"), F.col("foil").cast("int").alias("foil"), "rarity", "cardset"
    )
    defs = m.derive(VIEWS["card_defs"], part=m.spread("part"))
    return defs.select(
        F.col("card_id").cast("string").alias("doc"),
        F.to_json(F.create_map(F.col("card_id").cast("string"), entry)).alias("value"),
    )


def price_docs(m: Market) -> DataFrame:
    """One ``{id: price}`` document per price, named like the daily files."""
    prices = m.derive(VIEWS["card_prices"], lineitem=m.spread("lineitem"))
    return prices.select(
        F.concat(F.lit("price-history-"), F.date_format("date", "yyyy-MM-dd"), F.lit(".txt")).alias("file_name"),
        F.to_json(F.create_map(F.col("card_id").cast("string"), F.col("price"))).alias("value"),
    )


@query("src2_json_map", "SELECT card_id, cardname, foil, rarity, cardset FROM {card_defs}")
def src2(m):
    return documents.card_definitions(definition_docs(m))


@query("src3_json_prices", "SELECT card_id, date, price FROM {card_prices}")
def src3(m):
    return documents.card_price_rows(price_docs(m))


@query("src4_zip_members", "SELECT card_id, cardname, foil, rarity, cardset FROM {card_defs}")
def src4(m):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents = []
            for doc, value in zip(batch["doc"], batch["value"]):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(f"card-definitions-{doc}.txt", value)
                contents.append(buffer.getvalue())
            yield pd.DataFrame({"archive": batch["doc"], "content": contents})

    archives = definition_docs(m).mapInPandas(pack, "archive string, content binary")
    return documents.card_definitions(files.zip_members(archives), "text")


@query(
    "src9_json_fallback",
    f"""SELECT p_partkey AS card_id, CASE p_size%3 WHEN 0 THEN concat('https://img.example.com/large/',CAST(p_partkey AS VARCHAR),'.jpg')
          WHEN 1 THEN concat('https://img.example.com/face/',CAST(p_partkey AS VARCHAR),'.jpg') ELSE '{documents.NO_IMAGE}' END AS url
        FROM {{part}}""",
)
def src9(m):
    size = F.col("p_size") % 3

    def uris(kind: str):
        link = F.concat(F.lit(f"https://img.example.com/{kind}/"), F.col("p_partkey"), F.lit(".jpg"))
        return F.struct(F.struct(link.alias("large")).alias("image_uris"))

    hit = F.when(size == 0, F.to_json(F.struct(F.array(uris("large")).alias("data")))).when(
        size == 1, F.to_json(F.struct(F.array(F.struct(F.array(uris("face")).alias("card_faces"))).alias("data")))
    )
    doc = F.coalesce(hit, F.lit('{"data":[{"name":"plain"}]}'))
    return m["part"].select(F.col("p_partkey").alias("card_id"), documents.image_url(doc).alias("url"))


@query(
    "src10_forecast_decode",
    """SELECT p_partkey AS card_id, CAST(DATE '2001-01-01' + p_size + CAST(i AS INT) + 1 AS DATE) AS date, p_size + i*0.5 - 1 AS q05, p_size + i*0.5 AS q5,
         p_size + i*0.5 + 2 AS q85, p_size + i*0.5 + 4 AS first_sample, 2 AS n_samples
       FROM {part} CROSS JOIN (SELECT unnest(range(7)) AS i) s""",
)
def src10(m):
    def series(shift: float):
        return F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.col("p_size") + i * F.lit(0.5) + F.lit(shift))

    quantiles = F.create_map(F.lit("0.05"), series(-1.0), F.lit("0.5"), series(0.0), F.lit("0.85"), series(2.0))
    prediction = F.struct(quantiles.alias("quantiles"), F.array(series(4.0), series(5.0)).alias("samples"))
    responses = m["part"].select(
        F.col("p_partkey").alias("card_id"),
        F.date_add(F.lit("2001-01-01").cast("date"), F.col("p_size")).alias("last_day"),
        F.to_json(F.struct(F.array(prediction).alias("predictions"))).alias("response"),
    )
    rows = documents.forecast_rows(responses, ["0.05", "0.5", "0.85"], ["card_id"])
    return rows.select(
        "card_id", "date", "q05", "q5", "q85",
        F.col("samples")[0].alias("first_sample"), F.size("samples").alias("n_samples"),
    )


# --- HTML --------------------------------------------------------------------------

def page_item(title: str, day: str, price: str, shipping: str) -> str:
    """An item of a result page, as an SQL expression of those of its parts."""
    return f"""concat('<li><div class="s-item__info clearfix"><a href="#"><div class="s-item__title">', {title},
      '</div></a><div class="s-item__title--tag"><span class="POSITIVE">Sold  ', date_format({day},'MMM d, yyyy'),
      '</span></div><br><span class="s-item__price">', {price}, '</span>', {shipping}, '</div></li>')"""


FIRST_PRICE = """CASE l_linenumber
  WHEN 1 THEN concat('<span class="STRIKETHROUGH POSITIVE ITALIC">$', format_number(l_extendedprice,2), '</span>')
  WHEN 2 THEN concat('<span class="POSITIVE ITALIC">$', format_number(l_extendedprice,2), '</span>')
  WHEN 3 THEN concat('<span class="STRIKETHROUGH POSITIVE">$', format_number(l_extendedprice,2), '</span>')
  WHEN 6 THEN '<span class="POSITIVE">$1.00</span> to <span class="POSITIVE">$2.00</span>'
  WHEN 7 THEN '<span class="POSITIVE">$1.00 to $2.00</span>'
  ELSE concat('<span class="POSITIVE">$', format_number(l_extendedprice,2), '</span>') END"""
SHIPPING = """CASE WHEN l_linenumber=3 THEN '' WHEN l_linenumber%2=0
    THEN '<span class="s-item__shipping s-item__logisticsCost">Free shipping</span>'
  ELSE concat('<span class="s-item__shipping s-item__logisticsCost">+$', format_number(l_quantity,2), ' shipping</span>') END"""


def listing_pages(m: Market) -> DataFrame:
    """A page of three items per lineitem; the first one is never a listing."""
    plain = "concat('<span class=\"POSITIVE\">$', format_number(l_quantity,2), '</span>')"
    items = [
        page_item(title="'Shop on us'", day="l_shipdate", price=plain, shipping="''"),
        page_item(title="concat(p_name,' &amp; ',p_brand)", day="l_shipdate", price=FIRST_PRICE, shipping=SHIPPING),
        page_item(title="upper(p_name)", day="date_add(CAST(l_shipdate AS DATE),1)", price=plain, shipping="''"),
    ]
    html = "concat('<html><body><ul>'," + ",".join(items) + ",'</ul></body></html>')"
    return m.derive(
        f"SELECT l_orderkey*10+l_linenumber AS page_id, {html} AS html FROM {{lineitem}} JOIN {{part}} ON l_partkey=p_partkey",
        lineitem=m.spread("lineitem"),
    )


@query(
    "src5_html_listing",
    """SELECT l_orderkey*10+l_linenumber AS page_id, 1 AS position, concat(p_name,' & ',p_brand) AS title, CAST(l_shipdate AS DATE) AS carddate,
         CASE l_linenumber WHEN 1 THEN 'strikethrough italic' WHEN 2 THEN 'italic' WHEN 3 THEN 'BO accepted' WHEN 6 THEN NULL ELSE 'normal' END AS saletype,
         CASE WHEN l_linenumber IN (6,7) THEN NULL ELSE l_extendedprice END AS price,
         CASE WHEN l_linenumber=3 OR l_linenumber%2=0 THEN 0 ELSE l_quantity END AS shipping
       FROM {lineitem} JOIN {part} ON l_partkey=p_partkey
       UNION ALL SELECT l_orderkey*10+l_linenumber, 2, upper(p_name), CAST(l_shipdate AS DATE)+1, 'normal', l_quantity, 0
       FROM {lineitem} JOIN {part} ON l_partkey=p_partkey""",
)
def src5(m):
    return markup.listing_rows(listing_pages(m))


@query(
    "src6_html_links",
    """SELECT page_id, CAST(generate_subscripts(links,1)-1 AS INT) AS position, unnest(links) AS href FROM (
         SELECT page_id, regexp_extract_all(html,'href="([^"]*)"',1) AS links FROM {pages}) x""",
)
def src6_links(m):
    return markup.page_links(m["pages"])


@query(
    "src6_html_results",
    """SELECT o_orderkey AS page_id, 1 AS position, concat('/tournament/',CAST(o_orderkey AS VARCHAR)) AS href,
         strftime(o_orderdate,'%Y-%m-%d') AS entrydate, concat('Cup ',CAST(o_custkey AS VARCHAR)) AS tourntitle FROM {orders}
       UNION ALL SELECT o_orderkey, 2, '/tournament/0', strftime(o_orderdate,'%Y-%m-%d'), o_orderpriority FROM {orders}""",
)
def src6(m):
    pages = m.derive(
        """SELECT o_orderkey AS page_id, concat('<table><tr><th>Date</th><th><a href="/sort">Name</a></th></tr><tr class="odd">',
             '<td>',date_format(o_orderdate,'yyyy-MM-dd'),'</td><td><a href="/tournament/',CAST(o_orderkey AS STRING),'">Cup ',
             CAST(o_custkey AS STRING),'</a></td></tr><tr><td>',date_format(o_orderdate,'yyyy-MM-dd'),
             '</td><td><a class="x" href="/tournament/0">',o_orderpriority,'</a></td></tr></table>') AS html FROM {orders}"""
    )
    return markup.result_rows(pages)


@query(
    "src7_html_deck_links",
    """SELECT o_orderkey AS page_id, 0 AS position, concat('/deck/',CAST(o_custkey AS VARCHAR)) AS href FROM {orders}
       UNION ALL SELECT o_orderkey, 2, concat('/Deck/',CAST(o_orderkey AS VARCHAR)) FROM {orders} WHERE o_orderstatus='F'""",
)
def src7(m):
    pages = m.derive(
        """SELECT o_orderkey AS page_id, concat('<a href="/deck/outside">no</a><table class="table-tournament wide"><tr><td>',
             '<a href="/deck/',CAST(o_custkey AS STRING),'">first</a><a href="/player/1">p</a>',
             CASE WHEN o_orderstatus='F' THEN concat('<a href="/Deck/',CAST(o_orderkey AS STRING),'">second</a>') ELSE '' END,
             '</td></tr></table><table><tr><td><a href="/deck/after">no</a></td></tr></table>') AS html FROM {orders}""",
        orders=m.spread("orders"),
    )
    return markup.deck_links(pages)


@query(
    "src8_pairs",
    """SELECT l_orderkey, l_linenumber, p_name AS cardname, CAST(l_quantity AS INT) AS cardquant FROM {lineitem} JOIN {part} ON l_partkey=p_partkey
       UNION ALL SELECT l_orderkey, l_linenumber, p_type, 2 FROM {lineitem} JOIN {part} ON l_partkey=p_partkey
       UNION ALL SELECT l_orderkey, l_linenumber, p_brand, 3 FROM {lineitem} JOIN {part} ON l_partkey=p_partkey WHERE l_linenumber%2=0""",
)
def src8(m):
    # Odd lines have a price among the counts and one count too few, even ones a count too many.
    cell = "'<td class=\"text-right\">',{0},'</td>'"
    card = "'<td><a rel=\"popover\" href=\"/c\">',{0},'</a></td>'"
    counts = [
        cell.format("CAST(CAST(l_quantity AS INT) AS STRING)"),
        cell.format("CASE WHEN l_linenumber%2=1 THEN '$ 3.50' ELSE ' 2 ' END"),
        cell.format("CASE WHEN l_linenumber%2=1 THEN '2' ELSE '3' END"),
        cell.format("CASE WHEN l_linenumber%2=1 THEN 'n/a' ELSE '9' END"),
    ]
    parts = [counts[0], card.format("p_name"), counts[1], card.format("p_type"), counts[2], card.format("p_brand"), counts[3]]
    pages = m.derive(
        "SELECT l_orderkey, l_linenumber, concat('<div id=\"tab-online\"><a rel=\"popover\">no</a></div><div id=\"tab-paper\"><div><table><tr>',"
        + ",".join(parts)
        + ",'</tr></table></div></div><div id=\"tab-arena\"><td class=\"text-right\">7</td></div>') AS html "
        "FROM {lineitem} JOIN {part} ON l_partkey=p_partkey",
        lineitem=m.spread("lineitem"),
    )
    return markup.deck_cards(pages)
