import datetime as dt
import random
import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from marketloom.operators import digital, incremental, members, momentum, names, quantiles, ranks, sales, setmatch, shares
from marketloom.operators import series as S

D = dt.date


def test_median_is_exact(spark):
    rng = random.Random(5)
    data = [("hot", D(2024, 1, 1), rng.choice([rng.random() * 50, 7.0, 1e6 * rng.random()])) for _ in range(3001)]
    data += [("even", D(2024, 1, 1), float(rng.randint(0, 9))) for _ in range(400)]
    data += [("same", D(2024, 1, 1), 3.0)] * 50 + [("one", D(2024, 1, 2), 4.5), ("null day", None, 2.0), ("null day", None, 5.0)]
    data += [("gap", D(2024, 1, 3), None), ("gap", D(2024, 1, 3), 1.0), ("only null", D(2024, 1, 3), None)]
    # values that differ in their last bits, of either sign, far apart
    data += [("bits", D(2024, 1, 4), 1.0 + k * 2**-52) for k in range(40)]
    data += [("wide", D(2024, 1, 4), s * 10.0**e) for e in range(-300, 301, 20) for s in (-1, 1)]
    data += [("zero", D(2024, 1, 4), v) for v in (0.0, -0.0, -1e-300, 1e-300)]
    data += [("fine", D(2024, 1, 5), 20 + k * 1e-9) for k in range(5001)]
    df = spark.createDataFrame(data, "cardname string, carddate date, unit double").repartition(4)
    got = quantiles.avg_and_median(df, ["cardname", "carddate"], "unit")
    groups = {}
    for c, d, v in data:
        groups.setdefault((c, d), []).extend([v] if v is not None else [])
    result = {(r["cardname"], r["carddate"]): (r["avge"], r["med"]) for r in got.collect()}
    assert result.keys() == groups.keys()
    for key, values in groups.items():
        if not values:
            assert result[key] == (None, None)
            continue
        assert result[key][1] == pytest.approx(statistics.median(values), rel=1e-12)
        assert result[key][0] == pytest.approx(statistics.fmean(values), rel=1e-9, abs=1e-9 * max(map(abs, values)))


def test_median_of_one_day(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 10.0, 20.0)], "k string, v double")
    assert rows(quantiles.avg_and_median(df, ["k"], "v")) == [("a", 8.25, 6.0)]
    counted = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.when(F.col("v") == 1, 3).otherwise(F.col("n")))
    assert rows(quantiles.avg_and_median(counted, ["k"], "v", weight="n")) == [("a", pytest.approx(35 / 6), 1.5)]
    infinite = spark.createDataFrame([("a", v) for v in (1.0, float("inf"), float("inf"))], "k string, v double")
    assert rows(quantiles.avg_and_median(infinite, ["k"], "v").select("k", "med")) == [("a", float("inf"))]


def test_no_group_stands_in_one_buffer(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    plan = quantiles.avg_and_median(df, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert not any(f in plan for f in ("median", "percentile", "collect_", "ObjectHashAggregate"))


def test_equal_sales_count_once(spark):
    row = ("4x A", "A", D(2024, 1, 1), 8.0, 0.0, "normal", False)
    data = [row, row, ("A", "A", D(2024, 1, 1), 2.0, 0.0, "normal", False), ("A", "A", D(2024, 1, 1), 2.0, 0.0, "normal", None)]
    tx = spark.createDataFrame(
        data, "title string, cardname string, carddate date, price double, shipping double, saletype string, possiblybad boolean"
    ).withColumns({c: F.lit(None).cast("int") for c in ("availablequant", "cardquantity", "maybecardquantity")})
    listed = spark.createDataFrame([("A",)], "cardname string")
    assert rows(sales.daily_sale_price(tx, listed)) == [("A", D(2024, 1, 1), 5.0, 5.0)]


def test_names_in_all_ignores_null(spark):
    def f(*values):
        return spark.createDataFrame([(v,) for v in values], "cardname string")

    assert rows(names.names_in_all(f("a", "b", None, "a"), f("b", None, "a"), f("b", "c"))) == [("b",)]


def test_play_share(spark):
    d1 = D(2024, 1, 1)
    decks = spark.createDataFrame(
        [("A", d1, 4, "T1"), ("A", d1, 4, "T1"), ("A", d1, 2, "T2"), ("B", d1, 10, "T1")],
        "cardname string, entrydate date, cardquant int, tourntitle string",
    )
    everyone = decks.select("cardname").distinct()
    assert rows(shares.play_share(decks, everyone)) == [(d1, "A", 0.3), (d1, "B", 0.5)]
    # Cards outside the list still count below the line.
    assert rows(shares.play_share(decks, everyone.filter("cardname = 'B'"))) == [(d1, "B", 0.5)]


def test_shares_never_exceed_one(market):
    from marketloom.plans.queries_market import share

    worst = share(market, "standard").groupBy("entrydate").agg(F.sum("ratio").alias("s")).agg(F.max("s")).first()[0]
    assert worst <= 1 + 1e-9


def test_titles_like_are_dropped_but_null_titles_stay(spark):
    decks = spark.createDataFrame([("(x)",), ("x",), (None,)], "tourntitle string")
    assert rows(shares.without_titles_like(decks)) == [(None,), ("x",)]


def test_smallest_priced_version(spark):
    d = D(2024, 1, 1)
    prices = spark.createDataFrame(
        [(1, 9, d, 1.0), (2, 10, d, 2.0), (3, 10, D(2024, 1, 2), 3.0)], "id long, card_id long, date date, price double"
    )
    defs = spark.createDataFrame(
        [(2, "A", False, "Rare", "X"), (9, "A", False, "Common", "X"), (10, "A", False, "Mythic", "Y"), (11, "A", True, "Rare", "Y")],
        "card_id long, cardname string, foil boolean, rarity string, cardset string",
    )
    listed = spark.createDataFrame([("A",)], "cardname string")
    got = digital.canonical_price(prices, defs, listed).select("id", "card_id", "cardset")
    assert rows(got) == [(2, 10, "Y"), (3, 10, "Y")]


def _prices(spark, values):
    data = [("c", D(2024, 1, 1) + dt.timedelta(i), i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "cardname string, date date, id int, price double")


@pytest.mark.parametrize("values, slope, compat", [((1, 2, 4, 4), 1.1, 1.1), ((5,), 0.0, 0.0), ((1, 2, 4), 1.5, 0.0), ((9, 1, 2, 4, 4), 1.1, 1.1)])
def test_slope(spark, values, slope, compat):
    p = _prices(spark, values)
    assert momentum.momentum(p, days=None).first()["slope"] == pytest.approx(slope)
    assert momentum.momentum(p, days=None, compat=True).first()["slope"] == pytest.approx(compat)


def test_slope_ignores_older_rows_and_shifts(spark):
    p = _prices(spark, (50, 1, 2, 4, 4))
    moved = p.withColumn("price", F.col("price") + 7)
    a, b = (momentum.momentum(x, as_of="2024-01-05", days=4).first()["slope"] for x in (p, moved))
    assert a == pytest.approx(1.1) and b == pytest.approx(a)


def test_pages(spark):
    slopes = spark.createDataFrame([(f"c{i:02d}", float(i)) for i in range(45)], "cardname string, slope double")
    assert [momentum.winners_page(slopes, p).count() for p in range(3)] == [20, 20, 5]
    assert [momentum.losers_page(slopes, p).count() for p in range(3)] == [20, 20, 5]
    assert [momentum.losers_page(slopes, p, compat=True).count() for p in range(4)] == [1, 20, 20, 4]
    winners = [r[0] for p in range(3) for r in momentum.winners_page(slopes, p).collect()]
    losers = [r[0] for p in range(3) for r in momentum.losers_page(slopes, p).collect()]
    assert winners == losers[::-1] and losers[0] == "c00"


def test_global_rank(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")).repartition(5)
    got = ranks.global_rank(df, [F.desc("v")], "r", partitions=6)
    assert got.filter(F.col("r") != 1000 - F.col("v")).count() == 0 and got.count() == 1000


def test_fill(spark):
    data = [("c", D(2024, 1, 1) + dt.timedelta(i), v) for i, v in enumerate([None, 5.0, None, 7.0])]
    df = spark.createDataFrame(data + [("d", D(2024, 1, 1), None)], "cardname string, date date, v double")
    filled = df.select("cardname", "date", S.fill(F.col("v")).alias("v"))
    assert [r["v"] for r in filled.orderBy("cardname", "date").collect()] == [5.0, 5.0, 5.0, 7.0, None]
    again = filled.select("cardname", "date", S.fill(F.col("v")).alias("v"))
    assert rows(again) == rows(filled)


def test_align_and_reindex(spark):
    a = spark.createDataFrame([("c", D(2024, 1, 1), 1.0)], "cardname string, date date, a double")
    b = spark.createDataFrame([("c", D(2024, 1, 1), 2.0), ("c", D(2024, 1, 9), 3.0)], "cardname string, date date, b double")
    both = S.align({"a": a, "b": b})
    assert rows(both) == [("c", D(2024, 1, 1), 1.0, 2.0), ("c", D(2024, 1, 9), None, 3.0)]
    days = S.calendar(a.select("cardname"), F.lit("2024-01-01"), F.lit("2024-01-02"))
    assert rows(S.reindex(both, days)) == [("c", D(2024, 1, 1), 1.0, 2.0), ("c", D(2024, 1, 2), None, None)]


def test_lag_over_gaps(spark):
    s = spark.createDataFrame([("c", D(2024, 1, 1), 1.0), ("c", D(2024, 1, 8), 2.0), ("c", D(2024, 1, 9), 3.0)], "cardname string, date date, v double")
    got = S.lag_join(s, ["v"], 7).select("date", "v_lag")
    assert rows(got, "date") == [(D(2024, 1, 1), None), (D(2024, 1, 8), 1.0), (D(2024, 1, 9), None)]


@pytest.mark.parametrize("days, kept", [((2, 3, 5), (2, 3)), ((3, 4), ()), ((1, 2, 2, 3), (2, 3)), ((), ())])
def test_contiguous_prefix(spark, days, kept):
    df = spark.createDataFrame([(D(2024, 1, x),) for x in days], "d date")
    got = S.contiguous_prefix(df, F.lit("2024-01-01").cast("date"))
    assert rows(got, "d") == [(D(2024, 1, x),) for x in kept]


def test_prefix_stop(spark):
    days = ["2024-01-12", "2024-01-11", "2023-06-01", "2024-01-09", "2024-01-12"]
    page = spark.createDataFrame(
        [(1, i, D.fromisoformat(d)) for i, d in enumerate(days)], "page int, pos int, day date"
    )
    lo, hi = (F.lit(d).cast("date") for d in ("2024-01-10", "2024-01-12"))
    got = incremental.until_stop(page, ["page"], "pos", F.col("day"), lo, hi, F.lit(10))
    assert [r["pos"] for r in got.orderBy("pos").collect()] == [0, 1]


def test_bounds_of_known_and_new_cards(spark):
    new = spark.createDataFrame(
        [("known", D(2024, 1, 5)), ("known", D(2024, 1, 6)), ("new", D(2023, 10, 3)), ("new", D(2023, 10, 1)), ("known", D(2024, 1, 10))],
        "cardname string, carddate date",
    )
    stored = spark.createDataFrame([("known", D(2024, 1, 5)), ("known", D(2024, 1, 1))], "cardname string, carddate date")
    got = incremental.in_range(new, stored, "2024-01-10")
    assert rows(got) == [("known", D(2024, 1, 6)), ("new", D(2023, 10, 3))]


def test_pages_with_one_item_are_ignored(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "page int, t string")
    assert rows(incremental.with_several_items(items, ["page"]).select("page", "t")) == [(1, "a"), (1, "b")]


def test_set_match(spark):
    cards = spark.createDataFrame([("Thoughtseize", "LRW,THS,2XM"), ("Thoughtseize", " THS"), ("Ice", "ICE,ICE2")], "name string, printings string")
    sets = spark.createDataFrame(
        [("LRW", "Lorwyn", None), ("THS", "Theros", None), ("2XM", "Double Masters", "Masters II"), ("ICE", "Ice Age", None)],
        "code string, name string, mcmname string",
    )
    titles = [
        ("Thoughtseize (2) THS", "Thoughtseize", "THS"),
        ("Thoughtseize lrw masters ii", "Thoughtseize", "2XM"),
        ("Thoughtseize lorwyn ths", "Thoughtseize", "THS"),
        ("Thoughtseize Lorwyn", "Thoughtseize", "LRW"),
        ("Ice ice age", "Ice", "ICE"),
        ("Ice something", "Ice", None),
        ("Ice ICE2", "Ice", "ICE2"),
        ("Unknown THS", "Unknown", None),
    ]
    listings = spark.createDataFrame([t[:2] for t in titles], "title string, cardname string")
    got = setmatch.with_set(listings, setmatch.candidates(cards, sets)).select("title", "cardname", "cardset")
    assert set(rows(got)) == set(titles)


def test_scalar_subquery_fails_on_two_rows(spark):
    sets = spark.createDataFrame(
        [("A", "x", "core", D(2020, 1, 1)), ("B", "x", "core", D(2021, 1, 1))], "code string, mcmname string, type string, releasedate date"
    )
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        names.sets_since(sets, "x").collect()


def test_subscription_fold(spark):
    events = spark.createDataFrame(
        [
            (1, 10, 1, "registration.confirmed", None, None, None),
            (2, 20, 1, "checkout.completed", None, "s", 500),
            (3, 30, 1, "invoice.payment_failed", None, "s", None),
            (4, 40, 1, "invoice.paid", "open", "s", None),
            (5, 50, 2, "resumed", None, None, 900),
            (6, 10, 3, "resumed", None, "s", 900),
            (7, 20, 3, "paused", None, "s", None),
            (8, 20, 3, "invoice.paid", "active", "s", None),
        ],
        "event_id int, ts int, customer int, kind string, status string, subscription string, period_end long",
    )
    got = members.subscription_state(events)
    assert rows(got) == [(1, "unsubscribed", 500), (3, "subscribed", None)]
    assert rows(members.expire(got, 501)) == [(1, "unsubscribed", 500), (3, "subscribed", None)]
    assert rows(members.expire(got.withColumn("period_end", F.lit(5).cast("long")), 6)) == [(1, "unsubscribed", 5), (3, "unsubscribed", 5)]
