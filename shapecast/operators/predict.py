"""Prediction: a model's parameters, quantiles, centiles and intervals as projections of new rows, without a shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.expr import to_column, var
from ..plans.formula import Design
from .fit import Model


class PredictionSchemaError(ValueError):
    """code: missing_column, unseen_level or column_mismatch."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def check_schema(model: Model, df: DataFrame, parameters=None, levels: bool = True) -> None:
    """Raises PredictionSchemaError where df lacks a column, or has a factor level that the fit didn't see."""
    for p in parameters or model.parameters:
        d = model.designs[p]
        missing = [v for v in [*d.formula.variables(), *d.levels] if v not in df.columns and v != "factor"]
        if missing:
            raise PredictionSchemaError("missing_column", f"{p} needs {', '.join(sorted(set(missing)))}")
        if len(model.coefficients[p]) != len(d.names):
            raise PredictionSchemaError("column_mismatch", f"{p} has {len(model.coefficients[p])} coefficients for {len(d.names)} columns")
        if levels:
            for g, seen in d.levels.items():
                new = df.where(F.col(g).isNotNull() & ~F.col(g).cast("string").isin(seen)).select(g).first() if seen else None
                if new:
                    raise PredictionSchemaError("unseen_level", f"{g} has a level {new[0]!r} that the fit didn't see")


def eta_column(design: Design, beta: np.ndarray) -> Column:
    eta = F.lit(0.0)
    for c, b in zip(design.columns, beta, strict=True):
        eta = eta + F.lit(float(b)) * c
    return eta


def parameter_columns(model: Model, what: str = "response", which=None) -> dict[str, Column]:
    """Parameter -> Column over the rows of data with the model's variables. what: response or link."""
    out = {}
    for p in which or model.parameters:
        eta = eta_column(model.designs[p], model.coefficients[p])
        out[p] = eta if what == "link" else to_column(model.family.link(p).inverse(var("e")), {"e": eta})
    return out


def fixed_columns(model: Model) -> dict[str, Column]:
    return {f: F.col(model.fixed[f]).cast("double") if f in model.fixed else F.lit(v) for f, v in model.family.fixed.items()}


def predict_params(model: Model, newdata: DataFrame, which=None, what: str = "response", check: bool = True) -> DataFrame:
    """newdata with a column for each distribution parameter."""
    if check:
        check_schema(model, newdata, which, levels=False)
    return newdata.withColumns(parameter_columns(model, what, which))


def predict_response(model: Model, newdata: DataFrame, type: str = "response") -> DataFrame:
    """newdata with `fit`: the first parameter as response or link, or a column per term (type terms)."""
    p = model.parameters[0]
    if type == "terms":
        d = model.designs[p]
        return newdata.withColumns({b.label: sum((F.lit(float(x)) * c for x, c in zip(model.coefficients[p][sl], b.columns, strict=True)), F.lit(0.0)) for b, sl in zip(d.blocks, d.slices(), strict=True)})
    return newdata.withColumn("fit", parameter_columns(model, type, [p])[p])


def predict_mean(model: Model, newdata: DataFrame) -> DataFrame:
    """newdata with `mean`: the family's mean where it has one in closed form, else mu."""
    cols = parameter_columns(model)
    f = model.family
    if f.mean is None:
        return newdata.withColumn("mean", cols[model.parameters[0]])
    names = f.mean.__code__.co_varnames[: f.mean.__code__.co_argcount]
    values = {**cols, **fixed_columns(model)}
    return newdata.withColumn("mean", to_column(f.mean(**{k: var(k) for k in names}), {k: values[k] for k in names}))


def standard_error(model: Model, newdata: DataFrame, parameter: str = "mu") -> DataFrame:
    """newdata with `fit` and `se_fit` on the link scale: sqrt(x' V x), V the parameter's block of the covariance."""
    at = 0
    for p in model.parameters:
        size = len(model.coefficients[p])
        if p == parameter:
            v = model.vcov[at : at + size, at : at + size]
        at += size
    cols = model.designs[parameter].columns
    var_ = F.lit(0.0)
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            var_ = var_ + F.lit(float(v[i, j] * (1 if i == j else 2))) * a * cols[j]
    return newdata.withColumn("fit", eta_column(model.designs[parameter], model.coefficients[parameter])).withColumn("se_fit", F.sqrt(F.greatest(var_, F.lit(0.0))))


def predict_quantiles(model: Model, newdata: DataFrame, quantiles=(0.05, 0.25, 0.5, 0.75, 0.95), prefix: str = "q") -> DataFrame:
    """newdata with a column per probability, q0.05 as `q5`: the family's quantile function."""
    if any(not 0 < x < 1 for x in quantiles):
        raise ValueError("probabilities lie between 0 and 1")
    names = {x: f"{prefix}{x * 100:g}".replace(".", "_") for x in quantiles}
    return with_quantiles(model, newdata, names)


def with_quantiles(model: Model, df: DataFrame, names: dict[float, str]) -> DataFrame:
    cols = parameter_columns(model)
    if model.family.quantile:
        return df.withColumns({n: dist.quantile_column(model.family, float(x), cols) for x, n in names.items()})
    keep = df.columns
    out = df.withColumns({f"__{p}": c for p, c in {**cols, **fixed_columns(model)}.items()})
    for x, n in names.items():
        out = dist.with_values(out.withColumn("__p", F.lit(float(x))), model.family, "q", "__p", n, {p: f"__{p}" for p in [*cols, *model.family.fixed]})
    return out.select(*keep, *names.values())


def predict_quantile(model: Model, newdata: DataFrame, q: float = 0.5) -> DataFrame:
    return with_quantiles(model, newdata, {q: "quantile"})


def predict_interval(model: Model, newdata: DataFrame, alpha: float = 0.1) -> DataFrame:
    """newdata with `lower` and `upper` of the central 1 - alpha interval."""
    return with_quantiles(model, newdata, {alpha / 2: "lower", 1 - alpha / 2: "upper"})


def predict_distribution(model: Model, newdata: DataFrame) -> DataFrame:
    """newdata with `family` and a struct `params`."""
    cols = parameter_columns(model)
    return newdata.withColumn("family", F.lit(model.family.name)).withColumn("params", F.struct(*[c.alias(p) for p, c in cols.items()]))


def predict_all(model: Model, newdata: DataFrame | None = None) -> DataFrame:
    """All parameters and the response, of new rows or the fit's own."""
    df = model.data if newdata is None else newdata
    return df.withColumns(parameter_columns(model))


def centiles(model: Model, xvar: str, xvalues=None, cent=(5, 25, 50, 75, 95), fixed_values: dict | None = None, n: int = 100) -> DataFrame:
    """A row per value of xvar, with columns C5 ..: other variables at given values, or their mean or most frequent level."""
    spark = model.data.sparkSession
    if xvalues is None:
        lo, hi = model.data.agg(F.min(xvar), F.max(xvar)).first()
        xvalues = np.linspace(float(lo), float(hi), n).tolist()
    grid = spark.createDataFrame([(float(x),) for x in xvalues], f"{xvar} double")
    wanted = {v for p in model.parameters for v in [*model.designs[p].formula.variables(), *model.designs[p].levels]} - {xvar, "factor"}
    for v in sorted(wanted):
        value = (fixed_values or {}).get(v)
        if value is None:
            kind = dict(model.data.dtypes)[v]
            value = model.data.agg(F.mode(v) if kind == "string" or v in next(iter(model.designs.values())).levels else F.avg(v)).first()[0]
        grid = grid.withColumn(v, F.lit(value))
    return with_quantiles(model, grid, {c / 100: f"C{c:g}".replace(".", "_") for c in cent})


def centile_scores(model: Model, data: DataFrame, xvar: str | None = None) -> DataFrame:
    """data with `cdf` and `z`: the response's place in its predicted distribution."""
    return with_cdf(model, data).withColumn("z", dist.normal_quantile(F.least(F.greatest("cdf", F.lit(1e-12)), F.lit(1 - 1e-12))))


def with_cdf(model: Model, data: DataFrame, out: str = "cdf") -> DataFrame:
    from ..plans.formula import expression

    cols = {**parameter_columns(model), **fixed_columns(model)}
    made = dist.cdf_column(model.family, expression(model.response), cols)
    if made is not None:
        return data.withColumn(out, made)
    keep = data.columns
    wide = data.withColumns({f"__{p}": c for p, c in cols.items()}).withColumn("__y", expression(model.response))
    return dist.with_values(wide, model.family, "p", "__y", out, {p: f"__{p}" for p in cols}).select(*keep, out)


def with_log_density(model: Model, data: DataFrame, out: str = "loglik") -> DataFrame:
    from ..plans.formula import expression

    cols = {**parameter_columns(model), **fixed_columns(model)}
    if model.family.logpdf is not None:
        return data.withColumn(out, dist.density_column(model.family, expression(model.response), cols))
    keep = data.columns
    wide = data.withColumns({f"__{p}": c for p, c in cols.items()}).withColumn("__y", expression(model.response))
    return dist.with_values(wide, model.family, "logd", "__y", out, {p: f"__{p}" for p in cols}).select(*keep, out)


def sample(model: Model, newdata: DataFrame, seed: int = 0, out: str = "draw") -> DataFrame:
    """newdata with one draw per row from its predicted distribution, by inversion of rand(seed)."""
    keep = newdata.columns
    cols = {**parameter_columns(model), **fixed_columns(model)}
    wide = newdata.withColumns({f"__{p}": c for p, c in cols.items()}).withColumn("__u", F.rand(seed))
    return dist.with_values(wide, model.family, "q", "__u", out, {p: f"__{p}" for p in cols}).select(*keep, out)


def posterior_grid(model: Model, term: str, n: int = 50, parameter: str = "mu", fixed_values: dict | None = None) -> DataFrame:
    """Partial effect: the parameter over a grid of one variable with the others held (get_pef)."""
    g = centiles(model, term, None, (50,), fixed_values, n).drop("C50")
    out = predict_params(model, g, [parameter], check=False)
    from pyspark.sql import Window as W

    w = W.orderBy(term)
    return out.withColumn("gradient", (F.lead(parameter).over(w) - F.lag(parameter).over(w)) / (F.lead(term).over(w) - F.lag(term).over(w)))

