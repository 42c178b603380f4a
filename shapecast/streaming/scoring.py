"""Models over streams: scoring is a stateless projection; drift is watched by windowed sums of what a fit needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fit import Model
from ..operators.predict import parameter_columns, with_cdf, with_log_density
from ..plans.formula import expression


def score_stream(model: Model, stream: DataFrame) -> DataFrame:
    """The stream with parameters, log density and CDF of each row."""
    return with_cdf(model, with_log_density(model, stream.withColumns(parameter_columns(model))))


def windowed_scores(model: Model, stream: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per event-time window: n, mean log density and mean CDF (0.5 where the model still holds); rows later than `late` are left out."""
    s = score_stream(model, stream.withWatermark(time, late))
    return s.groupBy(F.window(time, window)).agg(F.count("*").alias("n"), F.avg("loglik").alias("loglik"), F.avg("cdf").alias("cdf")).select(F.col("window.start").alias("start"), "n", "loglik", "cdf")


def windowed_gram(stream: DataFrame, y: str, xs: list[str], time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per window the sums from which a Gaussian model of y on xs can be refitted: n, sums and cross products."""
    names = [*xs, y]
    aggs = [F.count("*").alias("n"), *[F.sum(expression(v)).alias(f"s_{v}") for v in names], *[F.sum(expression(a) * expression(b)).alias(f"{a}__{b}") for i, a in enumerate(names) for b in names[i:]]]
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(*aggs).select(F.col("window.start").alias("start"), *[c for c in ["n", *[f"s_{v}" for v in names], *[f"{a}__{b}" for i, a in enumerate(names) for b in names[i:]]]])
