import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from marketloom.operators import members, names
from marketloom.plans import queries_jobs
from marketloom.plans.queries_market import sale
from marketloom.streaming import daily, ingest, membership
from marketloom.streaming.files import file_stream

D = dt.date


def _split(df, path, parts):
    """The rows as several files, one per value of ``part``, in that order."""
    for i in range(parts):
        df.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return df.drop("part").schema


def test_membership_equals_batch(spark, market, tmp_path):
    events = market["sub_events"].withColumn("part", (F.col("event_id") % 3).cast("int"))
    schema = _split(events, str(tmp_path / "in"), 3)
    stream = file_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    membership.follow(stream, out, checkpoint)
    assert len(list((tmp_path / "out-changes").glob("batch=*"))) == 3
    want = rows(members.subscription_state(market["sub_events"]))
    state = membership.current(spark, out, market["sub_events"])
    assert rows(state) == want
    # The state is read from one version, not from the batches.
    assert all("version=0" in f for f in state.inputFiles())
    ends = sorted(r[2] for r in want if r[1] == members.SUBSCRIBED and r[2] is not None)
    since, as_of = ends[len(ends) // 3], ends[len(ends) // 2]
    over = membership.expired(spark, out, market["sub_events"], since, as_of)
    assert rows(over) == sorted((c, members.UNSUBSCRIBED, e) for c, r, e in want if r == members.SUBSCRIBED and e is not None and since <= e < as_of)
    assert "GreaterThanOrEqual(period_end" in over._jdf.queryExecution().executedPlan().toString()
    # A second run finds nothing new.
    membership.follow(file_stream(spark, str(tmp_path / "in"), schema, 1), out, checkpoint)
    assert rows(membership.current(spark, out, market["sub_events"])) == want


@pytest.mark.parametrize("files", [1, 4])
def test_daily_prices_equal_batch(spark, market, tmp_path, files):
    # Days are dealt over all files, so each file brings late sales.
    tx = market["transactions"].withColumn("part", F.pmod(F.xxhash64("title", "price"), F.lit(files)).cast("int"))
    schema = _split(tx, str(tmp_path / "in"), files)
    listed = names.names_in_all(market.decks("pioneer"), market.decks("modern"))
    out = str(tmp_path / "out")
    stream = file_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    daily.follow_daily_prices(stream, listed, out, str(tmp_path / "cp"))
    want = [(r[0], r[1], pytest.approx(r[2]), r[3]) for r in rows(sale(market).select("cardname", "carddate", "avge", "med"))]
    assert rows(daily.daily_prices(spark, out)) == want


def test_a_later_run_corrects_a_day(spark, market, tmp_path):
    tx = market["transactions"].withColumn("part", F.pmod(F.xxhash64("title", "price"), F.lit(2)).cast("int"))
    listed = names.names_in_all(market.decks("pioneer"), market.decks("modern"))
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(2):
        # what has come before comes again, and counts once
        tx.filter(F.col("part") <= part).drop("part").coalesce(1).write.mode("append").parquet(path)
        stream = file_stream(spark, path, tx.drop("part").schema)
        daily.follow_daily_prices(stream, listed, out, str(tmp_path / "cp"))
    want = [(r[0], r[1], pytest.approx(r[2]), r[3]) for r in rows(sale(market).select("cardname", "carddate", "avge", "med"))]
    assert rows(daily.daily_prices(spark, out)) == want


def _sales_run(spark, tmp_path, batches):
    data = [(*row, i) for i, b in enumerate(batches) for row in b]
    df = spark.createDataFrame(data, "title string, cardname string, carddate date, part int")
    schema = _split(df, str(tmp_path / "in"), len(batches))
    out = str(tmp_path / "out")
    ingest.ingest_sales(file_stream(spark, str(tmp_path / "in"), schema, 1), out, str(tmp_path / "cp"), "2024-01-10")
    return [r["title"] for r in spark.read.parquet(out).orderBy("title").collect()]


def test_sales_follow_each_cards_high_water(spark, tmp_path):
    batches = [
        [("A one", "A", D(2024, 1, 5)), ("B one", "B", D(2024, 1, 3)), ("A old", "A", D(2023, 1, 1))],
        [("A again", "A", D(2024, 1, 5)), ("A two", "A", D(2024, 1, 6)), ("B two", "B", D(2024, 1, 5)), ("C one", "C", D(2024, 1, 1))],
        [("B late", "B", D(2024, 1, 4)), ("A today", "A", D(2024, 1, 10)), ("nothing", "A", D(2024, 1, 9))],
    ]
    # One run has one mark, however its files are cut.
    first = ["A again", "A one", "A two", "B late", "B one", "B two", "C one"]
    assert _sales_run(spark, tmp_path, batches) == first
    later = [[("A same day", "A", D(2024, 1, 6)), ("B older", "B", D(2024, 1, 4))], [("A new", "A", D(2024, 1, 8)), ("C new", "C", D(2024, 1, 2))]]
    assert _sales_run(spark, tmp_path, later) == sorted([*first, "A new", "C new"])
    # The mark is carried on over a run that brings nothing of a card.
    assert _sales_run(spark, tmp_path, [[("B older", "B", D(2024, 1, 5)), ("B new", "B", D(2024, 1, 6))]]) == sorted([*first, "A new", "C new", "B new"])


def test_sales_go_on_from_a_seeded_store(spark, tmp_path):
    seeded = spark.createDataFrame([("A kept", "A", D(2024, 1, 5))], "title string, cardname string, carddate date")
    seeded.write.parquet(str(tmp_path / "out" / "batch=-1"))
    batches = [[("A older", "A", D(2024, 1, 4))], [("A new", "A", D(2024, 1, 7)), ("A next", "A", D(2024, 1, 6))]]
    assert _sales_run(spark, tmp_path, batches) == ["A kept", "A new", "A next"]


def test_known_tournaments_are_skipped(spark, tmp_path):
    runs = [
        [
            ("A", D(2024, 1, 1), 4, "T1", 0), ("A", D(2024, 1, 1), 2, "T1", 0), ("B", D(2024, 1, 2), 1, "T1", 0),
            ("A", D(2024, 1, 1), 4, "T1", 1), ("A", D(2024, 1, 2), 3, "T2", 1),
        ],
        [("A", D(2024, 1, 1), 4, "T1", 0), ("C", D(2024, 1, 3), 2, "T3", 0), ("D", D(2024, 1, 3), 2, "T3", 1)],
    ]
    out = str(tmp_path / "out")
    for data in runs:
        df = spark.createDataFrame(data, "cardname string, entrydate date, cardquant int, tourntitle string, part int")
        schema = _split(df, str(tmp_path / "in"), 2)
        ingest.ingest_entries(file_stream(spark, str(tmp_path / "in"), schema, 1), out, str(tmp_path / "cp"))
    got = ingest.stored_entries(spark, out).select("entrydate", "tourntitle", "cardname", "cardquant")
    assert rows(got) == [
        (D(2024, 1, 1), "T1", "A", 10), (D(2024, 1, 2), "T1", "B", 1), (D(2024, 1, 2), "T2", "A", 3),
        (D(2024, 1, 3), "T3", "C", 2), (D(2024, 1, 3), "T3", "D", 2),
    ]


def test_prices_are_read_once(spark, tmp_path):
    docs = spark.createDataFrame([("price-history-2024-01-02.txt", '{"1":2.5}')], "file_name string, value string")
    docs.write.parquet(str(tmp_path / "in"))
    places = str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):
        ingest.ingest_prices(file_stream(spark, str(tmp_path / "in"), docs.schema), *places)
    assert rows(spark.read.parquet(places[0])) == [(1, D(2024, 1, 2), 2.5)]


def test_sale_pages_in_any_cut(spark, market):
    """Pages of one search in several batches, copies among them, give the same sales."""
    whole = rows(queries_jobs.stored_sales(market, 1))
    assert len(whole) > 150 and rows(queries_jobs.stored_sales(market, 16)) == whole


def test_files_of_pages_grow_in_number_not_in_size(market, monkeypatch):
    sales = market["lineitem"].count()
    assert queries_jobs.files_per_batch(market, 3) == 1
    monkeypatch.setattr(queries_jobs, "FILE_ITEMS", sales // 12)
    assert queries_jobs.files_per_batch(market, 3) == 4
    given = []
    stream = lambda spark, path, *more, **named: given.append(spark.read.parquet(path)) or file_stream(spark, path, *more, **named)
    monkeypatch.setattr(queries_jobs, "file_stream", stream)
    assert queries_jobs.stored_sales(market).count() > 150
    assert len(given[0].inputFiles()) == 12


def _page(search, card, part, items, minute=0):
    """Items are day, title, price; the first of a page is no listing."""
    item = (
        '<div class="s-item__info clearfix"><div class="s-item__title">{1}</div><div class="s-item__title--tag"><span class="POSITIVE">'
        'Sold  {0}</span></div><span class="s-item__price"><span class="POSITIVE">{2}</span></span></div>'
    )
    html = "".join(item.format(*i) for i in [("Jan 1, 2024", "Shop on us", "$1"), *items])
    return (search, card, part, dt.datetime(2024, 1, 10, 0, minute), html)


def _sale_pages_run(spark, market, tmp_path, batches):
    schema = "search_id long, cardname string, part int, fetched timestamp, html string"
    for i, pages in enumerate(batches):
        spark.createDataFrame(pages, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    words = "array<struct<rank:int,code:string,word:string>>"
    sets = spark.createDataFrame([], f"cardname string, by_alias {words}, by_code {words}, by_name {words}")
    codes = spark.createDataFrame([], "code string")
    stream = file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    ingest.ingest_sale_pages(stream, sets, market["cards"], codes, str(tmp_path / "out"), str(tmp_path / "cp"), "2024-01-10")
    return rows(spark.read.schema(ingest.SALE).parquet(str(tmp_path / "out")).select("title", "carddate", "price"))


def test_a_stop_in_a_later_batch_takes_rows_back(spark, market, tmp_path):
    stored = spark.createDataFrame([("Elf", D(2024, 1, 3), "Elf kept")], "cardname string, carddate date, title string")
    stored.write.parquet(str(tmp_path / "out" / "batch=-1"))
    late = _page(1, "Elf", 1, [("Jan 8, 2024", "Elf after the stop", "$2.50")])
    early = _page(1, "Elf", 0, [
        ("Jan 9, 2024", "Elf foil", "$1,200.00"), ("Dec 1, 2023", "Elf stray", "$1"), ("Jan 10, 2024", "Elf of today", "$1"),
        ("Jan 9, 2024", "<b>no</b> title", "$1"), ("Jan 8, 2024", "other", "$1"), ("Jan 2, 2024", "Elf stop", "$1"), ("Jan 9, 2024", "Elf hidden", "$1"),
    ])
    new = _page(2, "Orc", 0, [("Oct 10, 2023", "orc x2", "$3"), ("Oct 1, 2023", "orc old", "$3"), ("Jan 9, 2024", "orc hidden", "$3")])
    again = _page(2, "Orc", 0, [("Jan 9, 2024", "orc copy", "$3")], minute=30)
    got = _sale_pages_run(spark, market, tmp_path, [[late], [early, new], [again]])
    assert got == [("Elf foil", D(2024, 1, 9), 1200.0), ("Elf kept", D(2024, 1, 3), None), ("orc x2", D(2023, 10, 10), 3.0)]
