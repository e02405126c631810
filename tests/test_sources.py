import datetime as dt
import io
import json
import random
import time
import zipfile

from conftest import rows
import pyarrow as pa
from pyspark.sql import functions as F

from marketloom import sinks
from marketloom.operators import incremental
from marketloom.sources import documents, elements, files, markup

D = dt.date


def test_price_files(spark, tmp_path):
    (tmp_path / "price-history-2024-01-02.txt").write_text(json.dumps({"7": 1.5, "8": 2}))
    (tmp_path / "nested").mkdir()
    (tmp_path / "nested" / "price-history-2024-01-03.txt").write_text(json.dumps({"7": 0.25}))
    (tmp_path / "other.txt").write_text("{}")
    got = files.price_files(spark, str(tmp_path))
    assert rows(got, "date", "card_id") == [(7, D(2024, 1, 2), 1.5), (8, D(2024, 1, 2), 2.0), (7, D(2024, 1, 3), 0.25)]


def test_zip_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "card-definitions.zip", "w") as z:
        z.writestr("a.txt", json.dumps({"3": {"name": "Ää", "foil": 1, "rarity": "Rare", "cardset": "X"}}))
        z.writestr("sub/", "")
        z.writestr("sub/b.txt", json.dumps({"4": {"name": "B", "foil": 0, "rarity": "Mythic", "cardset": "Y"}}))
    got = documents.card_definitions(files.zip_files(spark, str(tmp_path)), "text")
    assert rows(got) == [(3, "Ää", True, "Rare", "X"), (4, "B", False, "Mythic", "Y")]


def test_zip_members_of_bytes(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("m.txt", "text")
    df = spark.createDataFrame([("a", buffer.getvalue())], "archive string, content binary")
    assert rows(files.zip_members(df)) == [("a", "m.txt", "text")]


ITEM = """<div class="s-item__info clearfix"><div class="s-item__title">4x Thoughtseize NM English MTG</div>
<div class="s-item__title--tag"><span class="POSITIVE">Sold  Jan 12, 2024</span></div>
<span class="s-item__price"><span class="POSITIVE">$1,234.56</span></span>
<span class="s-item__shipping s-item__logisticsCost">+$0.99 shipping</span></div>"""


def _listings(spark, html):
    return rows(markup.listing_rows(spark.createDataFrame([(1, html)], "page_id long, html string")), "position")


def test_listing_page(spark):
    got = _listings(spark, f"<html><!-- {ITEM} -->{ITEM}<ul>{ITEM}</ul></html>")
    assert got == [(1, 1, "4x Thoughtseize NM English MTG", D(2024, 1, 12), "normal", 1234.56, 0.99)]


def test_price_classes(spark):
    def priced(spans):
        item = ITEM.replace('<span class="POSITIVE">$1,234.56</span>', spans)
        return _listings(spark, ITEM + item)[0][4:6]

    assert priced('<span class="STRIKETHROUGH POSITIVE ITALIC">$3</span>') == ("strikethrough italic", 3.0)
    assert priced('<span class="POSITIVE ITALIC">$3</span>') == ("italic", 3.0)
    assert priced('<span class="STRIKETHROUGH POSITIVE">$3</span><b><span class="NEGATIVE">$9</span></b>') == ("BO accepted", 3.0)
    assert priced('<span class="POSITIVE">$1.00 to $2.00</span>') == ("normal", None)
    assert priced('<span class="POSITIVE">$1</span><span class="POSITIVE">$2</span>') == (None, None)
    assert priced("$3") == (None, None)


def test_broken_markup(spark):
    assert _listings(spark, "") == []
    html = ITEM + '<div class="s-item__info clearfix"><div class="s-item__title">a &lt;b&gt; <i>c</i></div>'
    assert _listings(spark, html) == []  # markup beside the title's text
    html = html.replace("a &lt;b&gt; <i>c</i>", "<b><i>a &lt;b&gt;</i></b>")
    assert _listings(spark, html) == [(1, 1, "a <b>", None, None, None, 0.0)]
    html = html.replace("<b><i>a &lt;b&gt;</i></b>", "<i>a</i><i>b</i>")
    assert _listings(spark, html) == []


def test_pages_read_together_are_as_read_alone(monkeypatch):
    pages = [
        ITEM * 2, None, "", f"<p>é{ITEM}😀<!-- {ITEM} --><script>'<div>'</script >{ITEM}", ITEM + f"<div>{ITEM}</span>",
        ITEM + ITEM.replace("<span>", "<span/>").replace('"POSITIVE"', "'POSITIVE'") + ITEM.replace("<div ", '<DIV title="a>b" '),
        f"<table><tr><td>{ITEM}<td>{ITEM}</table>", ITEM.replace("Thoughtseize", "<b>A &amp; B</b>") + ITEM[:-6] + ITEM + "</div>",
        "<div>" * 70 + ITEM + ITEM + "</div>" * 70, "<span>a", ITEM + ITEM.replace("English", "&lt;é"),
    ]
    html = pa.array(pages, pa.string()).slice(1)
    found = lambda: [x.tolist() if hasattr(x, "tolist") else [c.to_pylist() for c in x] for x in markup._items_of(html)]
    together = found()
    monkeypatch.setattr(elements, "DEEPEST", 0)  # every page with a tag is scanned by itself
    assert together == found() and len(together[0]) == 9


def test_pages_in_order_are_read_at_once():
    html = pa.array([f"<html><ul>{ITEM * 3}</ul></html>"] * 3000)
    start = time.process_time()
    assert len(markup._items_of(html)[0]) == 6000
    together, start = time.process_time() - start, time.process_time()
    for page in html.to_pylist():
        markup._elements(page)
    assert 2 * together < time.process_time() - start


def test_deck_pages_are_read_at_once():
    row = '<td class="text-right">4</td><td><a rel="popover" href="/c">A &amp; B</a></td>'
    html = pa.array([f'<div id="tab-online">{row}</div><div id="tab-paper"><table><tr>{row * 9}</tr></table></div>'] * 3000)
    wanted = [("a", "rel", "popover"), ("td", "class", "text-right")]
    start = time.process_time()
    names, counts = markup._in_region(html, ("div", "id", "tab-paper"), wanted, markup._first_texts)
    together, start = time.process_time() - start, time.process_time()
    assert names[2999].as_py() == ["A & B"] * 9 and counts[0].as_py() == ["4"] * 9
    for page in html.to_pylist():
        markup._elements(page)
    assert 2 * together < time.process_time() - start


def test_each_different_tag_is_read_once():
    row = '<td class="text-right">4</td><td><a rel="popover" href="/c">A</a></td>'
    html = pa.array([f'<div id="tab-online">{row}</div><div id="tab-paper"><table><tr>{row * 9}</tr></table></div>'] * 3000)

    def seconds(run):
        start = time.process_time()
        run()
        return time.process_time() - start

    together = min(seconds(lambda: [elements.read(html.slice(low, high - low)) for low, high in elements.slices(html)]) for _ in range(3))
    assert 9 * together < min(seconds(lambda: [elements.elements(page) for page in html.to_pylist()]) for _ in range(2))


def test_any_pages_are_read_as_by_a_scan():
    parts = [
        "<div>", "</div>", "<DIV id=x>", "<td>", "</td >", "<tr>", "</tr>", "<table>", "</table>", '<a b="x>y">', "<a b='\"'>", "</a>", "<span/>",
        "<span>", "</span>", "<!--", "-->", "<script>", "</script>", "<p>", "<", "> ", "é😀", "x", "<ſpan>", "<tdé>", "<table", "</", "'", '"', "<!x>",
    ]
    some = random.Random(4)
    for _ in range(300):
        pages = ["".join(some.choices(parts, k=some.randrange(9))) for _ in range(20)]
        pages += [f"<div>{page}</div>" for page in pages[:3]] + ["<div><span a='1'>é</span><table><tr><td>1</td></tr></table></div>"]
        e, found, start = elements.read(pa.array(["<div>", *pages]).slice(1)), 0, 0
        for page in pages:
            alone = elements.elements(page)
            for i, x in enumerate(alone, found):
                assert e.attributes[e.kind[i]] == x.attributes and (x.tag == "ſpan" or elements.TAGS[e.tag[i]] == x.tag)
                assert (e.start[i] - start, e.end[i] - start) == tuple(len(page[:at].encode()) for at in (x.start, x.end))
                assert e.parent[i] == (x.parent + found if x.parent >= 0 else -1)
            found, start = found + len(alone), start + len(page.encode())
        assert found == len(e.page)


def test_deck_page(spark):
    html = """<div id="tab-online"><a rel="popover">No</a></div>
      <div class="x" id="tab-paper"><div><table><td class="text-right"> 4 </td><a rel="popover" href="#">One &amp; Two</a>
      <td class="text-right">$ 3.50</td></table></div><td class='text-right'>2</td><a rel="popover">B</a><a rel="popover">C</a></div>
      <div id="tab-arena"><td class="text-right">7</td></div>"""
    pages = spark.createDataFrame([("d1", html), ("d2", "<p>none</p>"), ("d3", None)], "deck string, html string")
    assert rows(markup.deck_cards(pages)) == [("d1", "B", 2), ("d1", "One & Two", 4)]


def test_counts_that_are_no_integers_cost_little(spark):
    texts = ["3", " +3 ", "-3", "\t3\n", "3\x00", "0003", "2147483647", "2147483648", "$ 3", "3.5", "3 4", "", "+", None]
    df = spark.createDataFrame([(texts,)], "t array<string>")
    assert df.select(markup.whole_numbers(F.col("t"))).first()[0] == [3, 3, -3, 3, 3, 3, 2147483647]

    def seconds(text):
        cells = F.array_repeat(F.concat(F.lit(text), F.col("id") % 7), 50)
        numbers = spark.range(20_000).select(F.size(markup.whole_numbers(cells)).alias("n"))
        start = time.perf_counter()
        numbers.agg(F.sum("n")).collect()
        return time.perf_counter() - start

    integers, others = (min(seconds(text) for _ in range(3)) for text in ("4", "n/a"))
    assert others < 4 * integers


def test_cards_leave_python_as_pairs(spark):
    texts = [
        "3", " +3 ", "-3", "\t3\n", "3\x00", "\x7f-0", "0003", "0" * 5000 + "7", "2147483647", "2147483648", "-2147483648", "-2147483649",
        "9" * 5000, "$ 3", "3.5", "3 4", "1_0", "٣", "3\u00a0", "", "+", " ",
    ]
    cast = spark.createDataFrame([(texts,)], "t array<string>").select(markup.whole_numbers(F.col("t"))).first()[0]
    assert [n for n in markup._whole_numbers(pa.array(texts)).to_pylist() if n is not None] == cast
    cells = "".join(f'<td class="text-right">{t}</td><td><a rel="popover">{i}</a></td>' for i, t in enumerate(texts))
    pages = spark.createDataFrame([(1, f'<div id="tab-paper">{cells}</div>'), (2, None)], "deck int, html string")
    cards = markup.deck_cards(pages)
    assert [tuple(r) for r in cards.collect()] == [(1, str(i), n) for i, n in enumerate(cast)]
    assert "Generate" not in cards._jdf.queryExecution().toString()  # no lists, which the JVM would take apart element by element


def test_a_slice_of_a_batch_is_read_without_the_rest():
    page = "<div>" + "x" * 50_000 + "</div>"
    html = pa.array([page] * 1200)

    def seconds(pages):
        start = time.process_time()
        for low, high in elements.slices(pages):
            assert len(elements.read(pages.slice(low, high - low)).page) == high - low
        return time.process_time() - start

    few = pa.array(html.slice(0, 120).to_pylist())
    small, large = (min(seconds(pages) for _ in range(2)) for pages in (few, html))
    assert large < 25 * small


def test_deck_page_without_end_tags(spark):
    html = """<div id="tab-paper"><table><tr><td class="text-right">4<td><a rel="popover">A</a><td class="text-right">$ 3
      <tr><td class="text-right"> 2 <b>x</b><td><a rel="popover">B<i>!</i></a><td class="text-right"><b>9</b></table></div>"""
    pages = spark.createDataFrame([("d", html)], "deck string, html string")
    assert rows(markup.deck_cards(pages)) == [("d", "A", 4), ("d", "B", 2)]
    wide = "<table>" + '<td class="text-right">1' * 20_000 + "</table>"
    found = markup._elements(wide)
    assert len(found) == 20_001 and {e.parent for e in found[1:]} == {0}


def test_new_rows_knows_null_keys(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b")], "id int, v string")
    assert rows(incremental.new_rows(a, a.filter("v = 'b'"), ["id"])) == [(1, "a")]


def test_deck_links(spark):
    html = """<a href="/deck/0">x</a><table class="a table-tournament"><table><a href='/Deck/1'>x</a></table>
      <a href="/player/2">x</a><a>x</a><a href=/deck/3>x</a></table><a href="/deck/4">x</a>"""
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert rows(markup.deck_links(pages).select("href")) == [("/Deck/1",), ("/deck/3",)]


def test_result_rows(spark):
    html = """<table><tr><th>Date</th></tr><tr class="r"><td>2024-01-02</td><td><a href="/t/1">Cup</a></td></tr></table>"""
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert rows(markup.result_rows(pages)) == [(1, 1, "/t/1", "2024-01-02", "Cup")]


def test_forecast_round_trip(spark):
    body = {"predictions": [{"quantiles": {"0.05": [1.0, 2.0], "0.5": [3.0, 4.0]}, "samples": [[5.0, 6.0], [7.0, 8.0]]}]}
    df = spark.createDataFrame([("c", D(2024, 1, 31), json.dumps(body))], "card string, last_day date, response string")
    got = documents.forecast_rows(df, ["0.05", "0.5"], ["card"])
    assert rows(got, "date") == [("c", D(2024, 2, 1), 1.0, 3.0, [5.0, 7.0]), ("c", D(2024, 2, 2), 2.0, 4.0, [6.0, 8.0])]


def test_request_writes_nan_as_text(spark):
    df = spark.createDataFrame([([1.0, float("nan")], [0.5])], "target array<double>, f array<double>")
    text = df.select(
        documents.forecast_request(F.lit("2024-01-01"), F.col("target"), F.array(F.lit(3)), F.array("f"), ["0.5"])
    ).first()[0]
    assert json.loads(text) == {
        "instances": [{"start": "2024-01-01", "target": [1.0, "NaN"], "cat": [3], "dynamic_feat": [[0.5]]}],
        "configuration": {"num_samples": 100, "output_types": ["quantiles"], "quantiles": ["0.5"]},
    }


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    b = spark.createDataFrame([(2, "x"), (3, "c")], "id int, v string")
    p = str(tmp_path / "t")
    sinks.full_refresh(a, p)
    sinks.append_new(b, p, ["id"])
    assert rows(spark.read.parquet(p)) == [(1, "a"), (2, "b"), (3, "c")]
    sinks.put(b, p)
    assert spark.read.parquet(p).count() == 3
    sinks.put(b, p, override=True)
    assert rows(spark.read.parquet(p)) == [(2, "x"), (3, "c")]
    j = str(tmp_path / "j")
    sinks.json_lines(a.coalesce(1), j)
    assert rows(spark.read.text(j)) == [('{"id":1,"v":"a"}',), ('{"id":2,"v":"b"}',)]
    s = str(tmp_path / "s")
    sinks.replace_ranked(spark.createDataFrame([("x", 2.0), ("y", -1.0)], "cardname string, slope double"), s)
    s += "/version=0"
    assert rows(spark.read.parquet(s), "id") == [(1, "y", -1.0), (2, "x", 2.0)]


def test_stray_end_tags_take_linear_time():
    for html in ("<div>" * 64_000 + "</a>" * 64_000, "<table><tr><td>" * 30_000 + "</tr></a>" * 30_000):
        start = time.process_time()
        assert len(markup._elements(html)) >= 64_000
        assert time.process_time() - start < 5


def test_a_reader_never_meets_half_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    sinks.refresh_version(first, path, through=7)
    assert sinks.committed(spark, path) == (0, 7)
    reader = sinks.read_version(spark, path)
    # The next version's rows are there, but not committed: as between the two steps of a refresh.
    first.filter("id = 1").write.parquet(f"{path}/version=1")
    assert rows(sinks.read_version(spark, path)) == [(1, "a"), (2, "b")]
    # The next refresh replaces what was left over, and may read the table itself.
    sinks.refresh_version(sinks.read_version(spark, path).withColumn("v", F.upper("v")), path)
    assert rows(sinks.read_version(spark, path)) == [(1, "A"), (2, "B")] and rows(reader) == [(1, "a"), (2, "b")]
    sinks.create_as(first, "made_by_test", path)
    assert rows(spark.table("made_by_test")) == [(1, "a"), (2, "b")]
    sinks.create_as(first.filter("id = 2"), "made_by_test", path)
    assert rows(spark.table("made_by_test")) == [(2, "b")]
    spark.sql("DROP TABLE made_by_test")
    assert rows(sinks.read_version(spark, str(tmp_path / "none"), "id int")) == []
