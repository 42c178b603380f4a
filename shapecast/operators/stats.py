"""What a fitted model says: criteria, tests, covariances, summaries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.expr import Numpy, special_ndtr
from .fit import Model, gamlss
from .predict import parameter_columns, with_log_density


def normal_tail(z: float) -> float:
    return float(2 * (1 - special_ndtr(Numpy, np.float64(abs(z)))))


def chi2_sf(x: float, df: float) -> float:
    return float(1 - dist.gammainc(df / 2, x / 2)) if x > 0 else 1.0


def fitted(model: Model, parameter: str = "mu", data: DataFrame | None = None) -> DataFrame:
    return (model.data if data is None else data).withColumn("fitted", parameter_columns(model)[parameter])


def linear_predictor(model: Model, parameter: str = "mu", data: DataFrame | None = None) -> DataFrame:
    return (model.data if data is None else data).withColumn("lp", parameter_columns(model, "link")[parameter])


def model_matrix(model: Model, parameter: str = "mu", data: DataFrame | None = None) -> DataFrame:
    d = model.designs[parameter]
    return (model.data if data is None else data).select(*[c.alias(n) for n, c in zip(d.names, d.columns, strict=True)])


def log_likelihood(model: Model) -> dict[str, float]:
    return {"loglik": -model.deviance / 2, "df": model.df_fit, "n": model.n}


def deviance_increment(model: Model, data: DataFrame | None = None) -> DataFrame:
    """data with `deviance`: -2 log density of each row."""
    return with_log_density(model, model.data if data is None else data, "__l").withColumn("deviance", -2 * F.col("__l")).drop("__l")


def gaic(*models: Model, k: float = 2.0, c: bool = False) -> list[tuple[int, float, float]]:
    """(index, df, GAIC), the smallest first."""
    return sorted(((i, m.df_fit, m.gaic(k, c)) for i, m in enumerate(models)), key=lambda x: x[2])


def gaic_table(*models: Model, k=None) -> list[dict]:
    ks = k or [2.0, 3.84, math.log(max(models[0].n, 1))]
    return [{"model": i, "df": m.df_fit, **{f"k={x:.4g}": m.gaic(x) for x in ks}} for i, m in enumerate(models)]


def gaic_weights(*models: Model, k: float = 2.0) -> list[float]:
    v = np.array([m.gaic(k) for m in models])
    w = np.exp(-(v - v.min()) / 2)
    return (w / w.sum()).tolist()


def gaic_scaled(*models: Model, k: float = 2.0) -> list[float]:
    v = np.array([m.gaic(k) for m in models])
    d = v - v.min()
    return (1 - d / (d.max() or 1.0)).tolist()


def likelihood_ratio_test(null: Model, alternative: Model) -> dict[str, float]:
    stat, df = null.deviance - alternative.deviance, alternative.df_fit - null.df_fit
    if df <= 0:
        raise ValueError("the alternative needs more degrees of freedom than the null model")
    return {"chi2": stat, "df": df, "p": chi2_sf(stat, df)}


def vuong_clarke_test(one: Model, two: Model, data: DataFrame | None = None) -> dict[str, float]:
    """On row differences of log density, both in one aggregation: Vuong's z and Clarke's sign test."""
    df = one.data if data is None else data
    both = with_log_density(two, with_log_density(one, df, "__a"), "__b").select((F.col("__a") - F.col("__b")).alias("d"))
    shift = (one.df_fit - two.df_fit) / 2 * math.log(one.n)
    r = both.agg(F.count("*").alias("n"), F.sum("d").alias("s"), F.stddev_pop("d").alias("sd"), F.sum((F.col("d") - shift / one.n > 0).cast("long")).alias("b")).first()
    z = (r["s"] - shift) / (math.sqrt(r["n"]) * r["sd"]) if r["sd"] else 0.0
    n, b = r["n"], r["b"]
    c = (b - n / 2) / math.sqrt(n / 4)
    return {"vuong_z": z, "vuong_p": normal_tail(z), "clarke_b": b, "clarke_p": normal_tail(c), "n": n}


def compare_models(*models: Model) -> list[dict]:
    """A row per model, with differences and the likelihood ratio p to the one before."""
    out = []
    for i, m in enumerate(models):
        row = {"model": i, "df": m.df_fit, "deviance": m.deviance, "aic": m.aic, "sbc": m.sbc}
        if i and m.df_fit > models[i - 1].df_fit:
            row |= {"d_deviance": models[i - 1].deviance - m.deviance, "p": likelihood_ratio_test(models[i - 1], m)["p"]}
        out.append(row)
    return out


def vcov(model: Model, type: str = "vcov"):
    """vcov, cor or se of all coefficients, in the order of the parameters."""
    v = model.vcov
    se = np.sqrt(np.maximum(np.diag(v), 0))
    if type == "se":
        return se
    return v / np.outer(se, se) if type == "cor" else v


def summary(model: Model) -> list[dict]:
    """A row per coefficient: estimate, standard error, z, p."""
    se, at, out = vcov(model, "se"), 0, []
    for p in model.parameters:
        for n, b in zip(model.designs[p].names, model.coefficients[p], strict=True):
            out.append({"parameter": p, "term": n, "estimate": float(b), "se": float(se[at]), "z": float(b / se[at]) if se[at] else math.nan, "p": normal_tail(b / se[at]) if se[at] else math.nan})
            at += 1
    return out


def confint(model: Model, level: float = 0.95) -> list[dict]:
    z = float(dist.q("NO", (1 + level) / 2, mu=0.0, sigma=1.0))
    return [{"parameter": r["parameter"], "term": r["term"], "lower": r["estimate"] - z * r["se"], "upper": r["estimate"] + z * r["se"]} for r in summary(model)]


def rsq(model: Model, type: str = "both"):
    """Cox-Snell and Cragg-Uhler against the intercept-only fit."""
    null = gamlss(f"{model.response} ~ 1", model.data, model.family, weights=model.weights, fixed=model.fixed, vcov=False)
    cs = 1 - math.exp((model.deviance - null.deviance) / model.n)
    cu = cs / (1 - math.exp(-null.deviance / model.n)) if null.deviance > 0 else math.nan
    return {"cox_snell": cs, "cragg_uhler": cu} if type == "both" else {"Cox Snell": cs, "Cragg Uhler": cu}[type]


def refit(model: Model, data: DataFrame | None = None, **changes) -> Model:
    """The stored formulas once more, on other data or with other options."""
    f = {p: model.designs[p].formula.text() for p in model.parameters}
    args = {"family": model.family, "weights": model.weights, "fixed": model.fixed, "parameter_formula": {p: "~" + f[p].split("~")[1] for p in model.parameters[1:]}}
    return gamlss(changes.pop("formula", f[model.parameters[0]]), model.data if data is None else data, **(args | changes))
