"""Bootstrap: resampling by Poisson weights, so that each replicate is one fit over the same rows and nothing is copied."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.formula import expression
from .fit import Model, gamlss
from .predict import sample


def poisson_weights(df: DataFrame, seed: int, out: str = "__w", key: list[str] | None = None) -> DataFrame:
    """df with Poisson(1) weights: a bootstrap sample that needs no row to move. key: columns that name a row, from which the weights are hashed, so that reruns agree however the rows are dealt; else they come from rand(seed)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)) + 0.5) / float(1 << 52) if key else F.rand(seed)
    col, total, p = F.lit(0), 0.0, np.exp(-1.0)
    df = df.withColumn("__u", u)
    for k in range(1, 19):  # what is above has a probability under the spacing of doubles
        total += p
        col = col + (F.col("__u") >= float(total)).cast("int")
        p /= k
    return df.withColumn(out, col.cast("double")).drop("__u")


def bootstrap_indices(spark, n: int, boots: int, seed: int = 0) -> DataFrame:
    """(boot, position, index): n draws with replacement for each replicate."""
    draw = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) / float(1 << 52) * n).cast("long")
    return spark.range(boots * n).select(F.expr(f"id div {n}").alias("boot"), F.expr(f"id % {n}").alias("position"), draw.alias("index"))


def resample(df: DataFrame, indices: DataFrame, row: str) -> DataFrame:
    """The rows that indices name, as often as they name them."""
    return indices.join(df, F.col("index") == F.col(row))


def confidence_intervals(estimates: np.ndarray, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Percentile intervals of the columns, over replicates without NaN."""
    ok = estimates[np.isfinite(estimates).all(axis=1)]
    return np.quantile(ok, alpha / 2, axis=0), np.quantile(ok, 1 - alpha / 2, axis=0)


def _collect(models) -> np.ndarray:
    return np.array(models)


def nonparametric_bootstrap(formula: str, data: DataFrame, family="NO", boots: int = 50, seed: int = 0, alpha: float = 0.05, key: list[str] | None = None, **options) -> dict:
    """Estimates (boots x coefficients), mean, standard error and percentile intervals; failed replicates are NaN rows."""
    df = data.persist()
    rows, size = [], None
    try:
        for b in range(boots):
            try:
                m = gamlss(formula, poisson_weights(df, seed + b, key=key), family, weights="__w", vcov=False, **options)
                rows.append(np.concatenate([m.coefficients[p] for p in m.parameters]))
                size = len(rows[-1])
            except (ValueError, np.linalg.LinAlgError):
                rows.append(None)
    finally:
        df.unpersist()
    est = np.array([np.full(size or 1, np.nan) if r is None else r for r in rows])
    lo, hi = confidence_intervals(est, alpha)
    return {"estimates": est, "mean": np.nanmean(est, axis=0), "se": np.nanstd(est, axis=0, ddof=1), "lower": lo, "upper": hi}


def parametric_bootstrap(model: Model, boots: int = 50, seed: int = 0, alpha: float = 0.05) -> dict:
    """Refits on responses drawn from the model."""
    from .stats import refit

    rows = []
    for b in range(boots):
        df = sample(model, model.data, seed + b, "__draw").drop(model.response).withColumnRenamed("__draw", model.response).persist()
        m = refit(model, df, vcov=False)
        df.unpersist()
        rows.append(np.concatenate([m.coefficients[p] for p in m.parameters]))
    est = np.array(rows)
    lo, hi = confidence_intervals(est, alpha)
    return {"estimates": est, "mean": est.mean(axis=0), "se": est.std(axis=0, ddof=1), "lower": lo, "upper": hi}


def residual_bootstrap(model: Model, key: str, boots: int = 50, seed: int = 0, alpha: float = 0.05) -> dict:
    """Refits on fitted means plus residuals drawn with replacement: each row takes the residual of a hashed rank.

    key: a numeric column that names a row. Residuals get their ranks once, and each replicate joins rows to them.
    """
    from .diagnose import ranked
    from .predict import parameter_columns
    from .stats import refit

    mu, y = parameter_columns(model)[model.parameters[0]], expression(model.response)
    base, n = ranked(model.data.where(y.isNotNull()).withColumn("__mu", mu), key, "__rank")
    base = base.withColumn("__res", y - F.col("__mu")).persist()
    res = base.select(F.col("__rank").alias("__take"), "__res")
    rows = []
    try:
        for b in range(boots):
            take = (F.pmod(F.xxhash64(F.lit(seed + b), "__rank"), F.lit(n)) + 1).cast("long")
            df = base.drop("__res").withColumn("__take", take).join(res, "__take").drop(model.response).withColumn(model.response, F.col("__mu") + F.col("__res"))
            m = refit(model, df, vcov=False)
            rows.append(np.concatenate([m.coefficients[p] for p in m.parameters]))
    finally:
        base.unpersist()
    est = np.array(rows)
    lo, hi = confidence_intervals(est, alpha)
    return {"estimates": est, "mean": est.mean(axis=0), "se": est.std(axis=0, ddof=1), "lower": lo, "upper": hi}


def group_bootstrap(data: DataFrame, column: str, family="NO", boots: int = 200, seed: int = 0, sample_rows: int = 100_000) -> DataFrame:
    """(boot, parameter, estimate) of intercept-only fits, one replicate per task; for columns of up to sample_rows rows."""
    n = data.count()
    if n > sample_rows:
        raise ValueError(f"{n} rows; use nonparametric_bootstrap over {sample_rows}")
    y = np.array([r[0] for r in data.select(F.col(column).cast("double")).dropna().collect()])  # at most sample_rows
    from ..functions.families import resolve
    from .fit import fit_local

    fam = resolve(family)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for b in pdf["id"]:
                w = np.random.default_rng([seed, int(b)]).multinomial(len(y), np.full(len(y), 1 / len(y))).astype(float)
                beta, _, _ = fit_local(fam, y, w=w)
                yield pd.DataFrame([(int(b), p, float(v[0])) for p, v in beta.items()], columns=["boot", "parameter", "estimate"])

    return data.sparkSession.range(0, boots, 1, max(1, boots // 16)).mapInPandas(run, "boot long, parameter string, estimate double")
