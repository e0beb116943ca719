"""Forecast of monthly orders by a straight line, over all orders or one line per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.sql import add, aggregate

TRAIN_SHARE = 0.8


def with_month_number(months: DataFrame) -> DataFrame:
    """month_numeric counts months on one axis: year * 12 + month."""
    return add(months, {"month_numeric": "order_year * 12 + order_month"})


def with_features(numbered: DataFrame, inputs: Sequence[str] = ("month_numeric",)) -> DataFrame:
    return VectorAssembler(inputCols=list(inputs), outputCol="features").transform(numbered)


def with_split(numbered: DataFrame, share: float = TRAIN_SHARE, by: Sequence[str] = ()) -> DataFrame:
    """is_train is true for the earlier ``share`` of the covered span of months, of each group of ``by`` on its own.

    Split by time instead of at random: the same rows in every run, and the model is judged on months
    it has not seen the future of. The span is a window over the months (of a group), which do not grow with the data.
    """
    over = f"OVER (PARTITION BY {', '.join(by)})" if by else "OVER ()"
    low, high = f"MIN(month_numeric) {over}", f"MAX(month_numeric) {over}"
    return add(numbered, {"is_train": f"month_numeric < {low} + ceil(({high} - {low} + 1) * {share}D)"})


SUMS = ("n", "x", "y", "xy", "xx")


def regression_sums(split: DataFrame, by: Sequence[str] = (), label: str = "total_orders") -> DataFrame:
    """What least squares needs of the training rows, per group and month: their number, and the sums of x, y, xy and xx.

    The rows add up: a store of them takes new months, and groups are merged, without a look at the orders again. ``label`` holds
    whole numbers; the sums are decimals without decimals, hence exact.
    """
    x, y = "CAST(month_numeric AS DECIMAL(19,0))", f"CAST({label} AS DECIMAL(19,0))"
    return aggregate(
        split.filter(f"is_train AND {label} IS NOT NULL"),
        [*by, "month_numeric"],
        {"n": "COUNT(*)", "x": f"SUM({x})", "y": f"SUM({y})", "xy": f"SUM({x} * {y})", "xx": f"SUM({x} * {x})"},
    )


def lines_of_sums(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """slope, intercept and months per group of ``by``, from any rows of ``regression_sums``; NULL for a group of one month."""
    total = aggregate(sums, by, {c: f"CAST(SUM({c}) AS DECIMAL(38,0))" for c in SUMS})
    # Differences of exact products, in double precision only once both are whole numbers.
    slope = "CAST(n * xy - x * y AS DOUBLE) / NULLIF(CAST(n * xx - x * x AS DOUBLE), 0.0D)"
    line = add(total, {"slope": slope, "intercept": "(CAST(y AS DOUBLE) - slope * CAST(x AS DOUBLE)) / CAST(n AS DOUBLE)"})
    return line.selectExpr(*by, "slope", "intercept", "CAST(n AS BIGINT) AS months")


def fit_line(split: DataFrame, by: Sequence[str] = (), label: str = "total_orders") -> DataFrame:
    """Least-squares slope and intercept on the training rows, one line per group of ``by``."""
    return aggregate(
        split.filter("is_train"),
        by,
        {
            "slope": f"regr_slope({label}, month_numeric)",
            "intercept": f"regr_intercept({label}, month_numeric)",
            "months": f"regr_count({label}, month_numeric)",
        },
    )


def predict(split: DataFrame, by: Sequence[str] = (), label: str = "total_orders") -> DataFrame:
    """Test months with prediction and error; the fitted line has one row per group."""
    test = split.filter("NOT is_train")
    line = lines_of_sums(regression_sums(split, by, label), by) if by else fit_line(split, by, label)
    if by:
        fitted = line.selectExpr(*[f"{c} AS {c}_of_line" for c in by], "struct(slope, intercept) AS line")
        same = [F.col(c).eqNullSafe(F.col(f"{c}_of_line")) for c in by]
        joined = test.join(fitted, same).drop(*[f"{c}_of_line" for c in by])
    else:
        fitted = line.selectExpr("struct(slope, intercept) AS line").scalar()
        joined = test.withColumn("line", fitted)
    predicted = add(
        joined,
        {
            "prediction": "line.slope * month_numeric + line.intercept",
            "residual": f"{label} - (line.slope * month_numeric + line.intercept)",
        },
    )
    return predicted.drop("line")


def rmse(predicted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return aggregate(predicted, by, {"rmse": "sqrt(avg(pow(residual, 2.0D)))", "test_months": "COUNT(residual)"})


def fit_model(split: DataFrame, label: str = "total_orders") -> LinearRegressionModel:
    """The same line as a fitted ML model, for use in ML workflows."""
    trainer = LinearRegression(featuresCol="features", labelCol=label, solver="normal")
    return trainer.fit(with_features(split.filter("is_train")))


def model_predictions(split: DataFrame, label: str = "total_orders") -> DataFrame:
    scored = fit_model(split, label).transform(with_features(split.filter("NOT is_train")))
    return scored.select("order_year", "order_month", label, "prediction")


def model_rmse(predictions: DataFrame, label: str = "total_orders") -> float:
    return RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="rmse").evaluate(predictions)
