"""Daily series: alignment, calendars, filling, lags, slopes, leaderboards, history views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators import digital, momentum, ranks
from marketloom.operators import series as S
from marketloom.plans import features, history
from marketloom.plans.queries_market import canonical, model_names, sale, share, universe
from marketloom.plans.registry import query
from marketloom.sources.tables import Market

START, CALENDAR_START = "1995-02-01", "1995-01-01"
LAST_DAY = "2001-11-01"


def inputs(m: Market) -> features.Inputs:
    return features.Inputs(
        sale=sale(m),
        digital=digital.daily_digital(canonical(m)),
        pioneer=share(m, "pioneer"),
        modern=share(m, "modern"),
        standard=share(m, "standard"),
        names=model_names(m),
    )


def window(m: Market) -> features.Window:
    """Days of a model run; the calendar ends with the data."""
    return features.Window(start=START, end=m.last_day or CALENDAR_START, calendar_start=CALENDAR_START)


def frame(m: Market) -> DataFrame:
    return features.feature_frame(inputs(m), window(m))


def modern_series(m: Market) -> DataFrame:
    return share(m, "modern").select("cardname", F.col("entrydate").alias("date"), "ratio")


def slopes(m: Market) -> DataFrame:
    return momentum.momentum(canonical(m), days=None)


# --- alignment and calendars -------------------------------------------------------


@query("j9_full_outer_align", "SELECT cardname, date, target, price0, modratio, pioratio, standratio FROM {aligned} WHERE cardname IN (SELECT cardname FROM {model_names})")
def j9(m):
    return features.aligned(inputs(m))


@query(
    "j10_calendar_reindex",
    """SELECT c.cardname, d.date, s.ratio FROM (SELECT DISTINCT cardname FROM {modern_share}) c CROSS JOIN {days} d
       LEFT JOIN {modern_share} s ON s.cardname=c.cardname AND s.entrydate=d.date""",
)
def j10(m):
    series = modern_series(m)
    days = S.calendar(series.select("cardname").distinct(), F.lit(CALENDAR_START), F.lit(window(m).end))
    return S.reindex(series, days)


@query(
    "f11_clip_from_first",
    """SELECT s.cardname, s.entrydate AS date, s.ratio FROM {standard_share} s JOIN (
         SELECT cardname, MIN(carddate) AS lo FROM {sale} GROUP BY cardname) f ON f.cardname=s.cardname
       WHERE s.entrydate >= f.lo""",
)
def f11(m):
    series = share(m, "standard").select("cardname", F.col("entrydate").alias("date"), "ratio")
    return S.clip_from_first(series, sale(m), "carddate")


# --- windows -----------------------------------------------------------------------


@query("w1_last_n", "SELECT cardname, date, id, price FROM {latest_rows}")
def w1(m):
    rows = canonical(m).select("cardname", "date", "id", "price")
    return ranks.last_rows(rows, "cardname", [F.desc("date"), F.desc("id"), F.desc("price")], momentum.LAST_ROWS)


@query(
    "w2_trailing_days",
    """SELECT c.cardname, c.date, c.id, c.price FROM {canonical} c JOIN (
         SELECT cardname, MAX(date) AS last FROM {canonical} GROUP BY cardname) l ON l.cardname=c.cardname
       WHERE c.date > l.last - 90""",
)
def w2(m):
    return momentum.trailing(canonical(m), None, 90).select("cardname", "date", "id", "price")


@query(
    "w3_ffill_bfill",
    """SELECT cardname, date,
         COALESCE(last_value(price0 IGNORE NULLS) OVER (PARTITION BY cardname ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(price0 IGNORE NULLS) OVER (PARTITION BY cardname ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price0
       FROM (SELECT n.cardname, d.date, g.price0 FROM (SELECT DISTINCT cardname FROM {digital}) n CROSS JOIN {days} d
             LEFT JOIN {digital} g ON g.cardname=n.cardname AND g.date=d.date) x""",
)
def w3(m):
    series = digital.daily_digital(canonical(m))
    days = S.calendar(series.select("cardname").distinct(), F.lit(CALENDAR_START), F.lit(window(m).end))
    return S.reindex(series, days).select("cardname", "date", S.fill(F.col("price0")).alias("price0"))


@query("w4_zero_fill", "SELECT cardname, date, COALESCE(ratio,0) AS ratio FROM {dense_share}")
def w4(m):
    return S.dense(modern_series(m)).select("cardname", "date", S.zero_fill(F.col("ratio")).alias("ratio"))


@query(
    "w5_calendar_lag",
    """SELECT a.cardname, a.entrydate AS date, a.ratio, b.ratio AS ratio_lag FROM {modern_share} a
       LEFT JOIN {modern_share} b ON b.cardname=a.cardname AND b.entrydate=a.entrydate-7""",
)
def w5(m):
    return S.lag_join(modern_series(m), ["ratio"], features.HORIZON)


@query("w5_dense_lag", "SELECT cardname, date, lag(ratio,7) OVER (PARTITION BY cardname ORDER BY date) AS ratio_lag FROM {dense_share}")
def w5_dense(m):
    dense = S.dense(modern_series(m))
    return dense.select("cardname", "date", S.lag_days(F.col("ratio"), features.HORIZON).alias("ratio_lag"))


@query(
    "w6_day_index",
    """SELECT cardname, entrydate AS date, CAST(entrydate - MIN(entrydate) OVER (PARTITION BY cardname) AS INT) AS day_no FROM {modern_share}""",
)
def w6(m):
    return modern_series(m).select("cardname", "date", S.day_index().alias("day_no"))


@query(
    "w7_date_split",
    """SELECT cardname, COUNT(*) FILTER (WHERE date BETWEEN DATE '1995-02-01' AND hi - 7) AS n_train, COUNT(*) AS n_test,
         MIN(date) AS first_day, MAX(date) AS last_day
       FROM {frame} CROSS JOIN {span} WHERE date BETWEEN DATE '1995-02-01' AND hi GROUP BY cardname""",
)
def w7(m):
    day, days = F.col("date"), window(m)
    return frame(m).filter(S.between(days.start, days.end)).groupBy("cardname").agg(
        F.count(F.when(day <= days.end_training, 1)).alias("n_train"),
        F.count(F.lit(1)).alias("n_test"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
    )


@query("w8_dense_freq", "SELECT cardname, date, ratio FROM {dense_share}")
def w8(m):
    return S.dense(modern_series(m))


@query(
    "w9_rank_id",
    "SELECT row_number() OVER (ORDER BY slope, cardname) AS id, cardname FROM {slopes}",
)
def w9(m):
    return momentum.ranked_slopes(slopes(m)).select("id", "cardname")


@query("w10_category_id", "SELECT category, cardname FROM {model_names}")
def w10(m):
    return features.categories(model_names(m))


@query(
    "w11_contiguous_prefix",
    """WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_shipdate > DATE '1996-01-01')
       SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) AS rn FROM d) x
       WHERE date_diff('day', DATE '1996-01-01', d) = rn""",
)
def w11(m):
    days = m["card_prices"].select(F.col("date").alias("d"))
    return S.contiguous_prefix(days, F.lit("1996-01-01").cast("date"))


@query(
    "w12_default_series",
    """SELECT n.cardname, MIN(COALESCE(s.ratio,0)) AS least, COUNT(s.ratio) AS played FROM (SELECT DISTINCT cardname FROM {card_defs}) n
       CROSS JOIN {days} d LEFT JOIN {modern_share} s ON s.cardname=n.cardname AND s.entrydate=d.date GROUP BY n.cardname""",
)
def w12(m):
    # Cards without any entry still get a full series of zeros.
    cards = m["card_defs"].select("cardname").distinct()
    days = S.calendar(cards, F.lit(CALENDAR_START), F.lit(window(m).end))
    full = S.reindex(modern_series(m), days)
    return full.groupBy("cardname").agg(
        F.min(S.zero_fill(F.col("ratio"))).alias("least"), F.count("ratio").alias("played")
    )


@query(
    "w13_future_index",
    """SELECT cardname, CAST(unnest(generate_series(CAST(last AS TIMESTAMP) + INTERVAL 1 DAY, CAST(last AS TIMESTAMP) + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS DATE) AS date
       FROM (SELECT cardname, MAX(carddate) AS last FROM {transactions} GROUP BY cardname) x""",
)
def w13(m):
    last = m["transactions"].groupBy("cardname").agg(F.max("carddate").alias("last"))
    return last.select("cardname", F.explode(S.future_days(F.col("last"), features.HORIZON)).alias("date"))


@query(
    "w14_history_plus_horizon",
    """SELECT cardname, COUNT(*) FILTER (WHERE date >= DATE '1995-02-01') AS n_target, COUNT(*) AS n_feature, SUM(CASE WHEN modratio>0 THEN 1 ELSE 0 END) AS played
       FROM {frame} CROSS JOIN {span} WHERE date BETWEEN DATE '1995-02-01' - 7 AND hi GROUP BY cardname""",
)
def w14(m):
    full = frame(m)
    series = features.serving_series(full, features.categories(model_names(m)), window(m))
    played = F.filter(F.col("dynamic_feat")[1], lambda v: v > 0)
    return series.select(
        "cardname",
        F.size("target").alias("n_target"),
        F.size(F.col("dynamic_feat")[0]).alias("n_feature"),
        F.size(played).alias("played"),
    )


# --- arrays ------------------------------------------------------------------------


@query(
    "a11_series_to_array",
    "SELECT cardname, CAST(row_number() OVER (PARTITION BY cardname ORDER BY entrydate)-1 AS INT) AS pos, ratio FROM {modern_share}",
)
def a11(m):
    arrays = modern_series(m).groupBy("cardname").agg(S.ordered_values("ratio").alias("values"))
    return arrays.select("cardname", F.posexplode("values").alias("pos", "ratio"))


# --- slopes and leaderboards ---------------------------------------------------------


query("a10_ols_slope", "SELECT cardname, slope FROM {slopes}")(slopes)


@query(
    "q6_momentum_trailing",
    """SELECT cardname, CASE WHEN COUNT(DISTINCT date)>1
         THEN regr_slope(price, CAST(date_diff('day', DATE '1970-01-01', date) AS DOUBLE)) ELSE 0.0 END AS slope
       FROM {latest_rows} WHERE date > DATE '2001-11-01' - 120 GROUP BY cardname""",
)
def q6(m):
    return momentum.momentum(canonical(m), as_of=LAST_DAY, days=120)


@query("t1_order_by", "SELECT cardname FROM {universe} ORDER BY cardname")
def t1(m):
    return universe(m).orderBy("cardname")


@query("t3_winners_page", "SELECT cardname, slope FROM {slopes} ORDER BY slope DESC, cardname LIMIT 20 OFFSET 20")
def t3(m):
    return momentum.winners_page(slopes(m), 1)


@query("t4_losers_page", "SELECT cardname, slope FROM {slopes} ORDER BY slope, cardname LIMIT 20")
def t4(m):
    return momentum.losers_page(slopes(m), 0)


@query("t4_losers_page_compat", "SELECT cardname, slope FROM {slopes} ORDER BY slope, cardname LIMIT 20 OFFSET 1")
def t4_compat(m):
    return momentum.losers_page(slopes(m), 1, compat=True)


@query("t5_sort_slopes", "SELECT cardname, slope FROM {slopes}")
def t5(m):
    return slopes(m).orderBy("slope", "cardname")


# --- price history -------------------------------------------------------------------


@query("q9_history_sale", "SELECT cardname, date, exp(target) AS value FROM {target} WHERE target IS NOT NULL")
def q9(m):
    return history.sale_history(sale(m))


@query(
    "q10_history_price0",
    """SELECT g.cardname, g.date, g.price0 AS value FROM {digital} g JOIN (
         SELECT cardname, MIN(carddate) AS lo FROM {sale} GROUP BY cardname) f ON f.cardname=g.cardname WHERE g.date >= f.lo""",
)
def q10(m):
    return history.digital_history(digital.daily_digital(canonical(m)), sale(m))


for _n, _format in ((11, "pioneer"), (12, "modern"), (13, "standard")):
    query(
        f"q{_n}_history_share_{_format}",
        f"""SELECT f.cardname, d.date, COALESCE(s.ratio,0) AS value FROM (
              SELECT cardname, MIN(carddate) AS lo FROM {{sale}} GROUP BY cardname) f
            JOIN {{days}} d ON d.date >= f.lo LEFT JOIN {{{_format}_share}} s ON s.cardname=f.cardname AND s.entrydate=d.date""",
    )(lambda m, f=_format: history.share_history(share(m, f), sale(m), CALENDAR_START, window(m).end))
