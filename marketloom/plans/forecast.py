"""Quantile forecasts with one pooled linear model per horizon step.

The model is least squares over all cards. A card's category enters as its
effect: how far its mean level lies from that of all cards, drawn towards 0 for
cards with few days. All steps are fitted from one aggregate, the sums of their
normal equations, and the coefficients form a small table the forecast joins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.operators import series as S
from marketloom.operators.quantiles import avg_and_median
from marketloom.plans.features import FEATURES, HORIZON
from marketloom.session import stored

CONTEXT = 7
QUANTILES = (0.05, 0.5, 0.85)
LAGS = tuple(f"lag{i}" for i in range(CONTEXT))
INPUTS = ("one", *LAGS, *FEATURES, "card_effect")
#: Days a card needs for half of its own effect, and what is added to the diagonal of the equations but for the constant.
SHRINK_DAYS = 10
RIDGE = 1.0


def examples(frame: DataFrame, end_training) -> DataFrame:
    """One row per card and day: what is known that day, and the next days' targets.

    Gaps of the target are filled forward for the inputs only, never from later
    days; labels stay as observed. Where an input is missing, a past target falls
    back to the card's level, the features to 0; such rows are not ``complete``
    and not learnt from.
    """
    seen = F.when(F.col("date") <= end_training, F.col("target"))
    mean = F.coalesce(frame.agg(F.avg(seen)).scalar(), F.lit(0.0))
    card = W.partitionBy("cardname")
    days = F.count(seen).over(card)
    effect = (F.coalesce(F.sum(seen).over(card), F.lit(0.0)) - days * mean) / (days + SHRINK_DAYS)
    known = frame.withColumns({"_filled": S.forward_fill(F.col("target")), "card_effect": effect, "_mean": mean})
    lags = [S.lag_days(F.col("_filled"), i).alias(f"lag{i}") for i in range(CONTEXT)]
    labels = [F.lead("target", h).over(S.by_day()).alias(f"y{h}") for h in range(1, HORIZON + 1)]
    rows = known.select("cardname", "date", F.lit(1.0).alias("one"), *lags, *FEATURES, "card_effect", "_mean", *labels)
    complete = F.lit(True)
    for c in INPUTS:
        complete = complete & F.col(c).isNotNull()
    level = F.col("_mean") + F.col("card_effect")
    spare = {c: F.coalesce(c, level) for c in LAGS} | {c: F.coalesce(c, F.lit(0.0)) for c in FEATURES}
    return rows.withColumn("complete", complete).withColumns(spare).drop("_mean")


def by_step(rows: DataFrame) -> DataFrame:
    """A row per example and step, with the step's label as ``actual``."""
    steps = [F.struct(F.lit(h).alias("step"), F.col(f"y{h}").alias("actual")) for h in range(1, HORIZON + 1)]
    return rows.select("cardname", "date", "complete", *INPUTS, F.inline(F.array(*steps)))


def _learnt(stepped: DataFrame, end_training) -> DataFrame:
    """Labels later than ``end_training`` are not seen."""
    return stepped.filter(F.col("complete") & F.col("actual").isNotNull() & (F.expr("date_add(date, step)") <= end_training))


def fit(stepped: DataFrame, end_training) -> DataFrame:
    """(step, weights): the coefficients of INPUTS for every step that has an example.

    The sums are combined in each task; one row per step reaches the driver.
    """
    n = len(INPUTS)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = [F.sum(F.col(INPUTS[i]) * F.col(INPUTS[j])).alias(f"a{i}_{j}") for i, j in pairs]
    sums += [F.sum(F.col(c) * F.col("actual")).alias(f"b{i}") for i, c in enumerate(INPUTS)]
    table = []
    for row in _learnt(stepped, end_training).groupBy("step").agg(*sums).collect():
        left = np.zeros((n, n))
        for i, j in pairs:
            left[i, j] = left[j, i] = row[f"a{i}_{j}"]
        left[np.arange(1, n), np.arange(1, n)] += RIDGE
        table.append((row.step, np.linalg.solve(left, [row[f"b{i}"] for i in range(n)]).tolist()))
    return stepped.sparkSession.createDataFrame(table, "step int, weights array<double>")


def predict(stepped: DataFrame, weights: DataFrame) -> DataFrame:
    """``cardname, date, complete, step, pred, actual``; steps without coefficients are left out."""
    pred = sum((F.col(c) * F.col("weights")[i] for i, c in enumerate(INPUTS)), F.lit(0.0))
    # one row per step
    return stepped.join(F.broadcast(weights), "step").select("cardname", "date", "complete", "step", pred.alias("pred"), "actual")


def residual_quantiles(predictions: DataFrame, end_training) -> DataFrame:
    """(step, e05, e50, e85): exact quantiles of the training error per step."""
    errors = _learnt(predictions, end_training).select("step", (F.col("actual") - F.col("pred")).alias("error"))
    errors = stored(errors, "errors")  # three passes over two narrow columns
    out = None
    for q in QUANTILES:
        one = avg_and_median(errors, ["step"], "error", "mean", _error(q), level=q).drop("mean")
        out = one if out is None else out.join(one, "step")
    return out


def _named(q: float) -> str:
    return "q" + f"{q:.2f}".split(".")[1]


def _error(q: float) -> str:
    return "e" + f"{q:.2f}".split(".")[1]


def forecast(frame: DataFrame, end_training, origin) -> DataFrame:
    """``cardname, date, step, q05, q50, q85, actual`` for the days after ``origin``.

    Errors are added on the log scale before ``exp``; both are monotone, so the
    quantiles keep their order.
    """
    stepped = by_step(stored(examples(frame, end_training), "examples"))
    fitted = predict(stepped, fit(stepped, end_training))
    spread = stored(residual_quantiles(fitted, end_training), "spread")
    out = fitted.filter(F.col("date") == origin).join(F.broadcast(spread), "step")  # one row per step
    return out.select(
        "cardname",
        F.expr("date_add(date, step)").alias("date"),
        "step",
        *[F.exp(F.col("pred") + F.col(_error(q))).alias(_named(q)) for q in QUANTILES],
        F.exp("actual").alias("actual"),
    )


def evaluate(forecasts: DataFrame) -> DataFrame:
    """Pinball loss per quantile and coverage of the band, per step."""
    known = forecasts.filter(F.col("actual").isNotNull())

    def pinball(q: float):
        diff = F.col("actual") - F.col(_named(q))
        return F.avg(F.greatest(diff * q, diff * (q - 1)))

    inside = F.col("actual").between(F.col("q05"), F.col("q85")).cast("double")
    return known.groupBy("step").agg(
        *[pinball(q).alias(f"pinball_{_named(q)}") for q in QUANTILES],
        F.avg(inside).alias("coverage"),
        F.count(F.lit(1)).alias("n"),
    )
