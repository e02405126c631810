"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import scalars
from marketloom.operators.names import only_names
from marketloom.plans.registry import query

IMAGES = "https://images.example.com/"


@query("x1_contains", "SELECT doc_id, contains(lower(text),'token') AS has_token FROM {documents}")
def x1(m):
    return m["documents"].select("doc_id", F.contains(F.lower("text"), F.lit("token")).alias("has_token"))


@query("x2_split_strip", "SELECT name, setcode, trim(unnest(string_split(printings,','))) AS code FROM {cards}")
def x2(m):
    return m["cards"].select("name", "setcode", F.explode(F.transform(F.split("printings", ","), lambda x: F.trim(x))).alias("code"))


@query(
    "x3_sold_date",
    "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS carddate FROM {lineitem}",
)
def x3(m):
    text = F.concat(F.lit("Sold  "), F.date_format("l_shipdate", "MMM d, yyyy"))
    return m["lineitem"].select("l_orderkey", "l_linenumber", scalars.sold_date(text).alias("carddate"))


@query(
    "x4_numeric_text",
    r"SELECT listing_id, title, TRY_CAST(NULLIF(regexp_replace(title,'[^0-9.]','','g'),'') AS DOUBLE) AS number FROM {listings}",
)
def x4(m):
    return m["listings"].select("listing_id", "title", scalars.numeric_text(F.col("title")).alias("number"))


@query(
    "x5_first_integer",
    r"SELECT listing_id, title, TRY_CAST(regexp_extract(title,'([0-9]+)',1) AS INT) AS number FROM {listings}",
)
def x5(m):
    return m["listings"].select("listing_id", "title", scalars.first_integer(F.col("title")).alias("number"))


@query(
    "x6_image_markdown",
    f"SELECT card_id, concat('![Unknown]({IMAGES}',replace(cardname,' ','+'),'.jpg)') AS tooltip FROM {{card_defs}}",
)
def x6(m):
    return m["card_defs"].select("card_id", scalars.image_markdown(IMAGES, F.col("cardname")).alias("tooltip"))


@query(
    "x7_dates",
    """SELECT event_id, CAST(ts - INTERVAL 8 HOUR AS DATE) AS pacific_day, strftime(ts,'%Y-%m-%d') AS utc_text,
         CAST(ts AS DATE) - 7 AS week_before FROM {events}""",
)
def x7(m):
    # The driver's days all lie in winter: eight hours behind UTC.
    ts = F.col("ts").cast("timestamp")
    return m["events"].select(
        "event_id",
        scalars.local_day(ts, "America/Los_Angeles").alias("pacific_day"),
        F.date_format(ts, "yyyy-MM-dd").alias("utc_text"),
        F.date_sub(ts.cast("date"), 7).alias("week_before"),
    )


@query(
    "x8_log_exp",
    """SELECT id, card_id, CASE WHEN price>0 THEN ln(price) END AS log_price, CASE WHEN price>0 THEN exp(ln(price)) END AS back
       FROM {card_prices}""",
)
def x8(m):
    price = F.col("price")
    log_price = F.when(price > 0, F.ln(price))
    return m["card_prices"].select("id", "card_id", log_price.alias("log_price"), F.exp(log_price).alias("back"))


@query("x9_least", "SELECT cardname, carddate, least(price,shipping) AS low FROM {transactions}")
def x9(m):
    return m["transactions"].select("cardname", "carddate", F.least("price", "shipping").alias("low"))


@query(
    "x10_floor_cast",
    """SELECT cardname, carddate, CAST(floor(price) AS BIGINT) AS whole, COALESCE(availablequant,cardquantity,1) AS quantity,
         CAST(isfoil AS INT) AS foil FROM {transactions}""",
)
def x10(m):
    return m["transactions"].select(
        "cardname",
        "carddate",
        F.floor("price").alias("whole"),
        F.coalesce("availablequant", "cardquantity", F.lit(1)).alias("quantity"),
        F.col("isfoil").cast("int").alias("foil"),
    )


@query(
    "x11_finite",
    "SELECT id, card_id, CASE WHEN isfinite(price) THEN CAST(price AS VARCHAR) <> '' ELSE FALSE END AS finite FROM {card_prices}",
)
def x11(m):
    text = F.to_json(F.struct(scalars.nan_for_missing(F.col("price")).alias("v")))
    return m["card_prices"].select("id", "card_id", (~F.contains(text, F.lit("NaN"))).alias("finite"))


@query("x12_json", "SELECT event_id, CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k FROM {events}")
def x12(m):
    doc = F.to_json(F.from_json("props", "k int"))
    return m["events"].select("event_id", F.get_json_object(doc, "$.k").cast("int").alias("k"))


@query(
    "x13_zip_member",
    """SELECT name, setcode, code, rarity FROM (
         SELECT name, setcode, rarity, trim(unnest(string_split(printings,','))) AS code FROM {cards}) x
       WHERE code IN (SELECT code FROM {sets} WHERE type='core')""",
)
def x13(m):
    codes = F.transform(F.split("printings", ","), lambda x: F.trim(x))
    pairs = F.arrays_zip(codes.alias("code"), F.array_repeat(F.col("rarity"), F.size(codes)).alias("rarity"))
    rows = m["cards"].select("name", "setcode", F.inline(pairs).alias("code", "rarity"))
    core = m["sets"].filter(F.col("type") == "core").select("code")
    return only_names(rows, core, "code").select("name", "setcode", "code", "rarity")


@query(
    "x14_scale_days",
    "SELECT l_orderkey, l_linenumber, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS day_no FROM {lineitem}",
)
def x14(m):
    start = F.lit("1995-01-01").cast("date")
    return m["lineitem"].select("l_orderkey", "l_linenumber", F.datediff("l_shipdate", start).alias("day_no"))
