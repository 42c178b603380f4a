"""Proper scores and calibration: one aggregation each over rows with their predicted parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..plans.formula import expression
from .fit import Model
from .predict import parameter_columns, with_cdf, with_log_density, with_quantiles


def log_score(model: Model, data: DataFrame) -> float:
    """Mean of -log density."""
    return with_log_density(model, data, "__l").agg(F.avg(-F.col("__l"))).first()[0]


def dss(model: Model, data: DataFrame) -> float:
    """Dawid-Sebastiani: mean of ((y - mu) / sigma)^2 + 2 log sigma, of the location and scale parameters."""
    c = parameter_columns(model)
    y, sigma = expression(model.response), c.get("sigma", F.lit(1.0))
    return data.agg(F.avg(F.pow((y - c["mu"]) / sigma, F.lit(2.0)) + 2 * F.log(sigma))).first()[0]


def crps_gaussian_column(y, mu, sigma):
    """Closed form for a normal distribution."""
    import math

    z = (y - mu) / sigma
    return sigma * (z * (2 * dist.normal_cdf(z) - 1) + 2 * F.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))


def crps(model: Model, data: DataFrame, method: str = "quantile", n: int = 99, seed: int = 0) -> float:
    """quantile: 2 / K sum of pinball losses at K levels; gaussian: closed form (NO only); sample: from pairs of draws."""
    y = expression(model.response)
    if method == "gaussian":
        if model.family.name != "NO":
            raise ValueError("the closed form is for NO")
        c = parameter_columns(model)
        return data.agg(F.avg(crps_gaussian_column(y, c["mu"], c["sigma"]))).first()[0]
    if method == "sample":
        from .predict import sample

        one = sample(model, data, seed, "__a")
        two = sample(model, one, seed + 1, "__b")
        return two.agg(F.avg(F.abs(F.col("__a") - y) + F.abs(F.col("__b") - y)) / 2 - F.avg(F.abs(F.col("__a") - F.col("__b"))) / 2).first()[0]
    levels = [(k + 1) / (n + 1) for k in range(n)]
    wide = with_quantiles(model, data, {p: f"__q{k}" for k, p in enumerate(levels)})
    loss = reduce(lambda a, b: a + b, [((y < F.col(f"__q{k}")).cast("double") - p) * (F.col(f"__q{k}") - y) for k, p in enumerate(levels)])
    return wide.agg(F.avg(2 * loss / n)).first()[0]


def interval_score(model: Model, data: DataFrame, alpha: float = 0.1) -> float:
    """Width plus 2 / alpha times what misses the central interval."""
    y = expression(model.response)
    w = with_quantiles(model, data, {alpha / 2: "__lo", 1 - alpha / 2: "__hi"})
    return w.agg(F.avg(F.col("__hi") - F.col("__lo") + 2 / alpha * (F.greatest(F.col("__lo") - y, F.lit(0.0)) + F.greatest(y - F.col("__hi"), F.lit(0.0))))).first()[0]


def coverage(model: Model, data: DataFrame, alpha: float = 0.1) -> float:
    y = expression(model.response)
    w = with_quantiles(model, data, {alpha / 2: "__lo", 1 - alpha / 2: "__hi"})
    return w.agg(F.avg(((y >= F.col("__lo")) & (y <= F.col("__hi"))).cast("double"))).first()[0]


def interval_coverage(data: DataFrame, y: str, lo: str, hi: str) -> float:
    return data.agg(F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double"))).first()[0]


def pinball(model: Model, data: DataFrame, q: float = 0.5) -> float:
    y = expression(model.response)
    return with_quantiles(model, data, {q: "__q"}).agg(F.avg(((y < F.col("__q")).cast("double") - q) * (F.col("__q") - y))).first()[0]


def pit_histogram(model: Model, data: DataFrame, n_bins: int = 10) -> DataFrame:
    """(bin, n) of the CDF at the response; empty bins have a row too."""
    bins = with_cdf(model, data, "__c").select(F.least(F.floor(F.col("__c") * n_bins), F.lit(n_bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    every = data.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(bins), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def scoring_summary(model: Model, data: DataFrame, alphas=(0.1, 0.2)) -> dict[str, float]:
    """Log score, CRPS, DSS, mae, rmse, and interval score and coverage at each alpha."""
    y, mu = expression(model.response), parameter_columns(model)["mu"]
    row = data.agg(F.avg(F.abs(y - mu)).alias("mae"), F.sqrt(F.avg((y - mu) * (y - mu))).alias("rmse")).first()
    out = {"log_score": log_score(model, data), "crps": crps(model, data), "dss": dss(model, data), "mae": row["mae"], "rmse": row["rmse"]}
    for a in alphas:
        out |= {f"interval_score_{1 - a:g}": interval_score(model, data, a), f"coverage_{1 - a:g}": coverage(model, data, a)}
    return out


class Regressor:
    """fit, predict and score over DataFrames."""

    def __init__(self, formula: str, family: str = "NO", **options):
        self.formula, self.family, self.options, self.model = formula, family, options, None

    def fit(self, data: DataFrame) -> Regressor:
        from .fit import gamlss

        self.model = gamlss(self.formula, data, self.family, **self.options)
        return self

    def predict(self, data: DataFrame) -> DataFrame:
        from .predict import predict_params

        return predict_params(self.model, data)

    def score(self, data: DataFrame) -> float:
        """Mean log density."""
        return -log_score(self.model, data)
