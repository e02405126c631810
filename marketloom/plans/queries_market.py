"""Sales, shares, canonical prices, names: filters, joins, aggregations, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions import predicates as P
from marketloom.functions import scalars
from marketloom.operators import digital, incremental, members, names, sales, setmatch, shares
from marketloom.plans.registry import query
from marketloom.plans.twins import UNIT
from marketloom.sources.tables import Market

SINCE_SET = "Edition 11"
# The days before this one count as stored already where a query needs "known" rows.
STORED_UNTIL = "2001-06-30"
AS_OF = "2001-09-01"


def played(m: Market) -> DataFrame:
    return m.once("played", lambda: names.names_in_all(m.decks("pioneer"), m.decks("modern")))


def universe(m: Market) -> DataFrame:
    return m.once("universe", lambda: names.names_in_all(m["transactions"], played(m)))


def sale(m: Market) -> DataFrame:
    """The card list is "sold and played". A sale proves by itself that its card
    is sold, so the sales need only the list of played names."""
    return sales.daily_sale_price(m["transactions"], played(m))


def share(m: Market, game_format: str) -> DataFrame:
    return shares.play_share(m.decks(game_format), universe(m))


def canonical(m: Market) -> DataFrame:
    return digital.canonical_price(m["card_prices"], m["card_defs"], universe(m))


def model_names(m: Market) -> DataFrame:
    return m.once("model-names", lambda: names.names_in_all(universe(m), m["card_defs"]))


# --- filters ---------------------------------------------------------------------


@query("f1_unit_price", f"SELECT cardname, carddate, title, {UNIT} AS unit FROM {{transactions}}")
def f1(m):
    return sales.with_unit_price(m["transactions"]).select("cardname", "carddate", "title", "unit")


@query(
    "f2_tri_state",
    """SELECT cardname, carddate, title, possiblybad IS FALSE AS bad_false, (lotis IS NULL OR lotis IS FALSE) AS lot_not_true,
         ismisprint IS NULL AS misprint_null, transplit IS TRUE AS split_true FROM {transactions}""",
)
def f2(m):
    return m["transactions"].select(
        "cardname",
        "carddate",
        "title",
        P.is_false(F.col("possiblybad")).alias("bad_false"),
        P.not_true(F.col("lotis")).alias("lot_not_true"),
        F.col("ismisprint").isNull().alias("misprint_null"),
        P.is_true(F.col("transplit")).alias("split_true"),
    )


@query(
    "f3_in_list",
    """SELECT cardname, carddate, title, saletype, cardset FROM {transactions}
       WHERE saletype IN ('normal') AND (cardset IS NULL OR cardset NOT IN ('LEA','LEB','U'))""",
)
def f3(m):
    rules = {"saletype": ("in", "normal"), "cardset": ("null_or_not_in", "LEA", "LEB", "U")}
    return m["transactions"].filter(P.from_rules(rules)).select("cardname", "carddate", "title", "saletype", "cardset")


@query(
    "f4_ratio_guard",
    """SELECT cardname, carddate, title, price, shipping FROM {transactions}
       WHERE COALESCE(shipping/NULLIF(price,0),0)<3""",
)
def f4(m):
    tx = m["transactions"]
    keep = P.ratio_below(F.col("shipping"), F.col("price"), sales.SHIPPING_RATIO)
    return tx.filter(keep).select("cardname", "carddate", "title", "price", "shipping")


@query(
    "f5_range_caps",
    f"""SELECT cardname, carddate, unit FROM (
          SELECT cardname, carddate, {UNIT} AS unit FROM {{transactions}} WHERE price+shipping<100) x WHERE unit<50""",
)
def f5(m):
    tx = m["transactions"].filter(F.col("price") + F.col("shipping") < sales.TOTAL_CAP)
    return sales.with_unit_price(tx).filter(F.col("unit") < sales.UNIT_CAP).select("cardname", "carddate", "unit")


@query(
    "f6_clean_sales",
    "SELECT title, cardname, carddate, unit FROM {clean_sales} WHERE cardname IN (SELECT cardname FROM {universe})",
)
def f6(m):
    return names.only_names(sales.clean_sales(m["transactions"]), universe(m)).select("title", "cardname", "carddate", "unit")


@query(
    "f7_ilike",
    """SELECT name, facename, setcode, name ILIKE '%//%' AS two_faced, name NOT ILIKE '%// ECONOMY%' AS not_economy
       FROM {cards} WHERE setcode ILIKE 'brand%'""",
)
def f7(m):
    name = F.col("name")
    return m["cards"].filter(F.col("setcode").ilike("brand%")).select(
        "name", "facename", "setcode", name.ilike("%//%").alias("two_faced"), (~name.ilike("%// ECONOMY%")).alias("not_economy")
    )


@query(
    "f8_point_lookup",
    """SELECT cardname, entrydate, cardquant, tourntitle FROM {modern_decks}
       WHERE cardname='small ring' AND (entrydate=DATE '1998-06-04' OR entrydate=DATE '1998-06-05')""",
)
def f8(m):
    days = [F.lit(d).cast("date") for d in ("1998-06-04", "1998-06-05")]
    return m.decks("modern").filter(
        (F.col("cardname") == "small ring") & ((F.col("entrydate") == days[0]) | (F.col("entrydate") == days[1]))
    )


def _stored_listings(m: Market) -> DataFrame:
    """What an earlier run has stored; one set of cards has no rows yet."""
    day, name = F.col("carddate"), F.col("cardname")
    return m["listings"].filter((day <= F.lit(STORED_UNTIL).cast("date")) & ~name.like("new %"))


_BOUNDS = f"""
    SELECT l.*, COALESCE(s.last + 1, DATE '{AS_OF}' - 100) AS lo, DATE '{AS_OF}' - 1 AS hi,
      CASE WHEN s.last IS NULL THEN 100 ELSE 10 END AS slack
    FROM {{listings}} l LEFT JOIN (
      SELECT cardname, MAX(carddate) AS last FROM {{listings}}
      WHERE carddate <= DATE '{STORED_UNTIL}' AND cardname NOT LIKE 'new %' GROUP BY cardname) s ON s.cardname=l.cardname"""


@query("f9_watermark_range", f"SELECT listing_id, cardname, carddate, title FROM ({_BOUNDS}) x WHERE carddate BETWEEN lo AND hi")
def f9(m):
    rows = incremental.in_range(m["listings"], _stored_listings(m), AS_OF)
    return rows.select("listing_id", "cardname", "carddate", "title")


@query(
    "f10_prefix_stop",
    f"""SELECT b.listing_id, b.cardname, b.carddate FROM ({_BOUNDS}) b LEFT JOIN (
          SELECT cardname, MIN(listing_id) AS stop FROM ({_BOUNDS}) y
          WHERE carddate < lo AND carddate + slack >= lo GROUP BY cardname) e ON e.cardname=b.cardname
        WHERE (e.stop IS NULL OR b.listing_id < e.stop) AND b.carddate BETWEEN b.lo AND b.hi""",
)
def f10(m):
    # A card's listings form its page; the listing id is the place on it.
    rows = incremental.with_bounds(m["listings"], _stored_listings(m), AS_OF)
    kept = incremental.until_stop(
        rows, ["cardname"], "listing_id", F.col("carddate"), F.col("_lo"), F.col("_hi"), F.col("_slack")
    )
    return kept.select("listing_id", "cardname", "carddate")


@query("f12_drop_null", "SELECT cardname, carddate, cardset FROM {transactions} WHERE cardset IS NOT NULL")
def f12(m):
    return m["transactions"].select("cardname", "carddate", "cardset").dropna(subset=["cardset"])


@query(
    "f13_name_guard",
    "SELECT listing_id, cardname, title FROM {listings} WHERE contains(lower(title),lower(cardname))",
)
def f13(m):
    return m["listings"].filter(P.contains_ci(F.col("title"), F.col("cardname"))).select("listing_id", "cardname", "title")


@query(
    "f14_nonempty_group",
    """SELECT listing_id, orderkey, title FROM {listings} WHERE orderkey IN (
         SELECT orderkey FROM {listings} GROUP BY orderkey HAVING COUNT(*)>1)""",
)
def f14(m):
    return incremental.with_several_items(m["listings"].select("listing_id", "orderkey", "title"), ["orderkey"]).select(
        "listing_id", "orderkey", "title"
    )


# --- joins -----------------------------------------------------------------------

query("j1_card_universe", "SELECT cardname FROM {universe}")(universe)
query("j2_train_universe", "SELECT cardname FROM {model_names}")(lambda m: model_names(m).orderBy("cardname"))


@query("j3_semi", "SELECT * FROM {modern_decks} WHERE cardname IN (SELECT cardname FROM {universe})")
def j3(m):
    return names.only_names(m.decks("modern"), universe(m))


@query(
    "j4_comma_join",
    """SELECT d.cardname, d.entrydate, d.cardquant, d.tourntitle, t.aggcount FROM {standard_decks} d,
         (SELECT entrydate, SUM(cardquant) AS aggcount FROM {standard_decks} GROUP BY entrydate) t
       WHERE d.entrydate=t.entrydate""",
)
def j4(m):
    decks = m.decks("standard")
    return decks.join(shares.day_total(decks), "entrydate").select("cardname", "entrydate", "cardquant", "tourntitle", "aggcount")


@query("j5_fact_dim", "SELECT id, card_id, date, price, cardname, cardset FROM {priced_versions}")
def j5(m):
    return digital.priced_versions(m["card_prices"], m["card_defs"], universe(m))


@query(
    "j6_argmin",
    "SELECT * FROM {card_defs} QUALIFY card_id = MIN(card_id) OVER (PARTITION BY cardname)",
)
def j6(m):
    return digital.smallest_version(m["card_defs"])


@query(
    "j7_anti",
    f"""SELECT card_id, date, price FROM {{card_prices}} p WHERE NOT EXISTS (
          SELECT 1 FROM {{card_prices}} s WHERE s.card_id=p.card_id AND s.date=p.date AND s.date <= DATE '{STORED_UNTIL}')""",
)
def j7(m):
    prices = m["card_prices"].select("card_id", "date", "price")
    stored = prices.filter(F.col("date") <= F.lit(STORED_UNTIL).cast("date"))
    return incremental.new_rows(prices, stored, ["card_id", "date"]).select("card_id", "date", "price")


@query(
    "j8_natural",
    """SELECT name, COUNT(*) AS n, MIN(setcode) AS first_set FROM {cards} NATURAL JOIN (
         SELECT DISTINCT cardname AS name FROM {pioneer_decks}) p GROUP BY name""",
)
def j8(m):
    played = m.decks("pioneer").select(F.col("cardname").alias("name")).distinct()
    return m["cards"].join(played, "name").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("setcode").alias("first_set"))


@query("j12_scalar_subquery", "SELECT code FROM {recent_sets}")
def j12(m):
    return names.sets_since(m["sets"], SINCE_SET)


@query(
    "j13_exists_flag",
    """SELECT n.name, CASE WHEN EXISTS (SELECT 1 FROM {cards} c WHERE c.name=n.name AND c.rarity='rare'
         AND c.setcode IN (SELECT code FROM {recent_sets})) THEN 'rare' ELSE 'mythic' END AS rarity
       FROM (SELECT DISTINCT name FROM {cards}) n""",
)
def j13(m):
    codes = names.sets_since(m["sets"], SINCE_SET)
    return names.rarity_of(m["cards"].select("name").distinct(), m["cards"], codes)


SET_HITS = """
    SELECT l.listing_id, l.title, l.cardname, k.code,
      CASE WHEN contains(lower(l.title),lower(s.mcmname)) THEN 0
           WHEN contains(lower(l.title),lower(k.code)) AND NOT contains(lower(l.cardname),lower(k.code)) THEN 1
           WHEN contains(lower(l.title),lower(s.name)) THEN 2 END AS kind,
      s.mcmname, s.name
    FROM (SELECT DISTINCT listing_id, title, cardname FROM {listings}) l JOIN {printed_in} k ON k.name=l.cardname
    LEFT JOIN {sets} s ON s.code=k.code"""


@query(
    "j14_dictionary_match",
    f"""SELECT l.listing_id, l.title, b.cardset FROM {{listings}} l LEFT JOIN (
          SELECT listing_id, title, cardname, code AS cardset FROM (
            SELECT *, row_number() OVER (PARTITION BY listing_id, title, cardname
              ORDER BY kind, length(CASE kind WHEN 0 THEN mcmname WHEN 1 THEN code ELSE name END) DESC, code) AS rn
            FROM ({SET_HITS}) h WHERE kind IS NOT NULL) r WHERE rn=1) b
          ON b.listing_id=l.listing_id AND b.title=l.title AND b.cardname=l.cardname""",
)
def j14(m):
    return setmatch.with_set(m.listings, sets_per_card(m)).select("listing_id", "title", "cardset")


def sets_per_card(m: Market) -> DataFrame:
    """Two-faced cards are listed under their face name."""
    cards = m["cards"].withColumn("listed", F.coalesce("facename", "name"))
    return setmatch.candidates(cards, m["sets"], "listed")


@query(
    "j15_membership",
    """SELECT c_custkey AS id, c_name FROM {customer} WHERE c_nationkey IN (
         SELECT n_nationkey FROM {nation} JOIN {region} ON n_regionkey=r_regionkey WHERE r_name='EUROPE')""",
)
def j15(m):
    # Customers as users, their nation as the link, regions as roles.
    users = m["customer"].select(F.col("c_custkey").alias("id"), "c_name")
    nation = m["nation"].select("n_nationkey", F.col("n_regionkey").alias("role_id"))
    links = m["customer"].join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("user_id"), "role_id"
    )
    roles = m["region"].select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return members.members_of(users, links, roles, "EUROPE")


# --- aggregations ----------------------------------------------------------------


@query(
    "a1_daily_avg",
    f"""SELECT cardname, carddate, AVG(unit) AS avge FROM (SELECT cardname, carddate, {UNIT} AS unit FROM {{transactions}}) x
        GROUP BY cardname, carddate""",
)
def a1(m):
    return sales.with_unit_price(m["transactions"]).groupBy("cardname", "carddate").agg(F.avg("unit").alias("avge"))


@query(
    "a2_daily_median",
    f"""SELECT cardname, carddate, quantile_cont(unit,0.5) AS med FROM (
          SELECT cardname, carddate, {UNIT} AS unit FROM {{transactions}}) x GROUP BY cardname, carddate""",
)
def a2(m):
    rows = sales.with_unit_price(m["transactions"])
    return sales.avg_and_median(rows, ["cardname", "carddate"], "unit").select("cardname", "carddate", "med")


query("a3_daily_sale_price", "SELECT cardname, carddate, avge, med FROM {sale}")(sale)


@query("a4_day_total", "SELECT entrydate, SUM(cardquant) AS aggcount FROM {standard_decks} GROUP BY entrydate")
def a4(m):
    return shares.day_total(m.decks("standard"))


for _format in ("pioneer", "modern", "standard"):
    query(f"a5_play_share_{_format}", f"SELECT entrydate, cardname, ratio FROM {{{_format}_share}}")(
        lambda m, f=_format: share(m, f)
    )


@query(
    "a6_min_max",
    "SELECT cardname, MIN(carddate) AS first_day, MAX(carddate) AS last_day FROM {transactions} GROUP BY cardname",
)
def a6(m):
    return m["transactions"].groupBy("cardname").agg(F.min("carddate").alias("first_day"), F.max("carddate").alias("last_day"))


@query("a7_distinct_rows", "SELECT DISTINCT title, cardname, carddate, unit FROM {clean_sales}")
def a7(m):
    return sales.clean_sales(m["transactions"]).distinct()


@query("a8_distinct_keys", "SELECT DISTINCT cardname FROM {transactions}")
def a8(m):
    return m["transactions"].select("cardname").distinct()


@query(
    "a9_nested_sum",
    "SELECT entrydate, tourntitle, cardname, SUM(cardquant) AS cardquant FROM {modern_decks} GROUP BY entrydate, tourntitle, cardname",
)
def a9(m):
    return shares.event_counts(m.decks("modern"))


@query("a12_robust_price", "SELECT cardname, date, target FROM {target}")
def a12(m):
    return sale(m).select("cardname", F.col("carddate").alias("date"), scalars.robust_price(F.col("avge"), F.col("med")).alias("target"))


query("q5_canonical", "SELECT id, card_id, date, price, cardname, cardset FROM {canonical}")(canonical)


@query(
    "t2_drilldown",
    """SELECT price, title FROM {transactions} WHERE cardname='small ring' AND carddate=DATE '1998-06-04'
       ORDER BY price, title LIMIT 10""",
)
def t2(m):
    return sales.drill_down(m["transactions"], "small ring", "1998-06-04")


# --- set operations --------------------------------------------------------------


@query(
    "s1_union",
    "SELECT name FROM {cards} WHERE name NOT ILIKE '%//%' UNION SELECT facename FROM {cards} WHERE name ILIKE '%//%'",
)
def s1(m):
    two_faced = F.col("name").ilike("%//%")
    return m["cards"].select(F.when(two_faced, F.col("facename")).otherwise(F.col("name")).alias("name")).distinct()


@query(
    "s2_difference",
    "SELECT cardname FROM {transactions} EXCEPT SELECT cardname FROM {modern_decks}",
)
def s2(m):
    sold = m["transactions"].select("cardname").distinct()
    return incremental.new_rows(sold, m.decks("modern"), ["cardname"])


@query("s3_set_union", "SELECT name, code FROM {printed_in}")
def s3(m):
    cards = m["cards"].withColumn("listed", F.coalesce("facename", "name"))
    return setmatch.printings(cards, "listed")


@query("s5_target_names", "SELECT name FROM {target_names}")
def s5(m):
    return names.target_names(m["cards"], m["sets"], [m.decks("pioneer"), m.decks("modern")], SINCE_SET)


# --- subscriptions, batch form -----------------------------------------------------

EXPIRY = 1_708_000_000


@query("st4_subscription_state", "SELECT customer, role, period_end FROM {members}")
def st4(m):
    return members.subscription_state(m["sub_events"])


@query(
    "st5_expiry",
    f"SELECT customer, CASE WHEN period_end < {EXPIRY} THEN 'unsubscribed' ELSE role END AS role, period_end FROM {{members}}",
)
def st5(m):
    return members.expire(members.subscription_state(m["sub_events"]), EXPIRY)
