"""Feature frame, training documents, forecasts and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.plans import features, forecast
from marketloom.plans.queries_market import model_names
from marketloom.plans.queries_series import START, frame, inputs, window
from marketloom.plans.registry import query
from marketloom.session import stored
from marketloom.sources import documents
from marketloom.sources.tables import Market

query("m1_feature_frame", "SELECT cardname, date, target, price0, modratio, pioratio, standratio FROM {frame}")(frame)


def instances(m: Market, test: bool = False) -> DataFrame:
    build = features.test_set if test else features.training_set
    return build(frame(m), features.categories(model_names(m)), window(m))


def _rows(docs: DataFrame) -> DataFrame:
    """Training documents back as one row per day, by array position."""
    zipped = F.arrays_zip(
        F.col("target"), *[F.col("dynamic_feat")[i].alias(c) for i, c in enumerate(features.FEATURES)]
    )
    rows = docs.select("cardname", "category", F.posexplode(zipped).alias("pos", "z"))
    value = F.col("z.target")
    return rows.select(
        "cardname", "category", "pos", F.when(~F.isnan(value), value).alias("target"),
        *[F.col("z")[c].alias(c) for c in features.FEATURES],
    )


def _twin(end: str) -> str:
    return f"""SELECT l.cardname, n.category, CAST(l.date - DATE '1995-02-01' AS INT) AS pos,
                 l.target, l.price0, l.modratio, l.pioratio, l.standratio
               FROM {{lagged}} l JOIN {{model_names}} n ON n.cardname=l.cardname CROSS JOIN {{span}}
               WHERE l.date BETWEEN DATE '1995-02-01' AND {end}"""


@query("m2_training_set", _twin("hi - 7"))
def m2(m):
    return _rows(instances(m))


@query("m6_test_set", _twin("hi"))
def m6_set(m):
    return _rows(instances(m, test=True))


@query(
    "q17_training_documents",
    """SELECT CAST(category AS INT) AS category, '1995-02-01 00:00:00' AS start, CAST(hi - 7 - DATE '1995-02-01' + 1 AS INT) AS n_target, 4 AS n_features
       FROM {model_names} CROSS JOIN {span}""",
)
def q17(m):
    docs = features.documents(instances(m)).select(F.to_json(F.struct("*")).alias("value"))
    schema = "start string, target array<string>, cat array<int>, dynamic_feat array<array<double>>"
    d = F.from_json("value", schema)
    return docs.select(
        d["cat"][0].alias("category"), d["start"].alias("start"), F.size(d["target"]).alias("n_target"),
        F.size(d["dynamic_feat"]).alias("n_features"),
    )


@query(
    "a13_length_check",
    """SELECT cardname, CAST(COUNT(*) AS INT) AS n_target, CAST(COUNT(price0) + COUNT(*) FILTER (WHERE price0 IS NULL) AS INT) AS shortest,
         CAST(COUNT(*) AS INT) AS longest, TRUE AS ok
       FROM {lagged} CROSS JOIN {span} WHERE date BETWEEN DATE '1995-02-01' AND hi - 7 GROUP BY cardname""",
)
def a13(m):
    return features.length_check(instances(m))


@query("q16_model_cards", "SELECT category, cardname FROM {model_names}")
def q16(m):
    return features.categories(model_names(m)).orderBy("cardname")


@query(
    "m5_request_encode",
    """SELECT n.category, CAST(l.date - DATE '1995-02-01' AS INT) AS pos, l.target FROM {frame} l JOIN {model_names} n ON n.cardname=l.cardname CROSS JOIN {span}
       WHERE l.date BETWEEN DATE '1995-02-01' AND hi""",
)
def m5(m):
    series = features.serving_series(frame(m), features.categories(model_names(m)), window(m))
    text = documents.forecast_request(
        F.lit(START), F.col("target"), F.array("category"), F.col("dynamic_feat"), ["0.05", "0.5", "0.85"]
    )
    body = F.from_json(text, "instances array<struct<start:string,target:array<string>,cat:array<int>>>")
    sent = series.select(body["instances"][0].alias("i"))
    rows = sent.select(F.col("i.cat")[0].alias("category"), F.posexplode("i.target").alias("pos", "v"))
    return rows.select("category", "pos", F.when(F.col("v") != "NaN", F.col("v").cast("double")).alias("target"))


def _forecast(m: Market) -> DataFrame:
    # One written frame serves the fit and the forecast; the last known day is
    # one horizon before the end, so that the outcome is known.
    until = window(m).end_training
    return forecast.forecast(stored(_known(m), "frame"), until, until)


def _known(m: Market) -> DataFrame:
    """The frame as it was known day by day: nothing filled from later days."""
    return features.feature_frame(inputs(m), window(m), backward=False)


@query("m3_forecast", "SELECT cardname, date, step, q05, q50, q85, actual FROM {forecast}")
def m3(m):
    return _forecast(m)


@query(
    "m4_quantiles_in_order",
    """SELECT step, COUNT(*) AS n, COUNT(*) FILTER (WHERE q05 <= q50 AND q50 <= q85) AS n_ordered, AVG(q85 - q05) AS width
       FROM {forecast} GROUP BY step""",
)
def m4(m):
    ordered = (F.col("q05") <= F.col("q50")) & (F.col("q50") <= F.col("q85"))
    width = F.avg(F.col("q85") - F.col("q05"))
    return _forecast(m).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.count_if(ordered).alias("n_ordered"), width.alias("width"))


_PINBALL = ", ".join(f"AVG(greatest((actual-q{n})*{q}, (actual-q{n})*({q}-1))) AS pinball_q{n}" for n, q in (("05", 0.05), ("50", 0.5), ("85", 0.85)))


@query(
    "m6_holdout_eval",
    f"""SELECT step, {_PINBALL}, AVG(CASE WHEN actual BETWEEN q05 AND q85 THEN 1.0 ELSE 0.0 END) AS coverage, COUNT(*) AS n
        FROM {{forecast}} WHERE actual IS NOT NULL GROUP BY step""",
)
def m6(m):
    return forecast.evaluate(_forecast(m))


@query("q15_days_ahead", "SELECT cardname, date, step, q05, q50, q85 FROM {ahead}")
def q15(m):
    """The days after the last one, for every card of the registry."""
    last = F.lit(window(m).end).cast("date")
    return forecast.forecast(stored(_known(m), "frame"), last, last).drop("actual")
