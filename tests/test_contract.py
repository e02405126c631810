"""The driver contract, SQL twins on a small scale, and the shape of plans."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as contract
from marketloom.plans import registry
from marketloom.sources.views import STORED

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check_twins import compare  # noqa: E402

QUERIES, TWINS = contract.queries(), contract.oracle_sql()

# The whole set runs with tools/check_twins.py; these cover each family.
QUICK = [
    "a3_daily_sale_price", "a5_play_share_standard", "q5_canonical", "a10_ols_slope", "t4_losers_page_compat",
    "f2_tri_state", "f9_watermark_range", "f10_prefix_stop", "j9_full_outer_align", "j14_dictionary_match",
    "s5_target_names", "m2_training_set", "m5_request_encode", "q13_history_share_standard", "w3_ffill_bfill",
    "w11_contiguous_prefix", "src4_zip_members", "src5_html_listing", "src6_html_links", "src8_pairs",
    "src10_forecast_decode", "snk4_replace_rank", "snk7_put_if_absent", "st1_incremental_sales", "st5_stream_expiry",
    "e5_tournament_ingest", "e5_digital_ingest", "m3_forecast", "m6_holdout_eval", "tag_special", "tag_quantity", "tag_graded_strict", "x7_dates",
]


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in STORED:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_twin(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert compare(got, duck.execute(TWINS[name]).df()) in ("exact", "close")


def test_names():
    assert set(TWINS) <= set(QUERIES)
    # Of the library itself; the optional subpackage tests what SQL cannot express against brute force.
    assert set(registry.callables()) == set(registry.twins())


def test_entry(spark):
    assert contract.entry(spark).columns == ["cardname", "carddate", "avge", "med"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_forecast_quantiles_are_ordered(spark, sf_dir):
    row = QUERIES["m4_quantiles_in_order"](spark, sf_dir).collect()
    assert len(row) == 7 and all(r["n"] == r["n_ordered"] > 0 for r in row)


@pytest.mark.parametrize("name", ["a3_daily_sale_price", "a5_play_share_modern", "q5_canonical", "j9_full_outer_align", "j14_dictionary_match", "m1_feature_frame", "q12_history_share_modern", "f9_watermark_range", "st4_subscription_state"])
def test_no_nested_loops_and_no_python(spark, sf_dir, name):
    plan = _plan(QUERIES[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert bad not in plan


def test_last_rows_are_cut_before_the_shuffle(spark, sf_dir):
    plan = _plan(QUERIES["w1_last_n"](spark, sf_dir))
    assert plan.count("WindowGroupLimit") >= 2 and ", Partial" in plan


def test_top_k_is_not_a_full_sort(spark, sf_dir):
    assert "TakeOrderedAndProject" in _plan(QUERIES["t3_winners_page"](spark, sf_dir))


def test_scan_is_pruned_and_filtered(spark, sf_dir):
    plan = _plan(QUERIES["a7_distinct_rows"](spark, sf_dir))
    assert "l_comment" not in plan and "o_totalprice" not in plan and "l_discount" not in plan
    plan = _plan(QUERIES["src1_table_scan"](spark, sf_dir))
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan


def test_play_share_reads_decks_once(spark, sf_dir):
    plan = _plan(QUERIES["a5_play_share_modern"](spark, sf_dir))
    # One scan of the decks, one of their cards, one of the card list.
    assert plan.split("== Initial Plan ==")[0].count("FileScan") == 3


def test_flagship_paths_share_one_shuffle(spark, sf_dir):
    df = QUERIES["a3_daily_sale_price"](spark, sf_dir)
    df.collect()
    final = _plan(df).split("== Initial Plan ==")[0]
    # No group is hot here: the second path is gone, and sales were read once.
    assert "percentile_approx" not in final and final.count("FileScan") <= 4

