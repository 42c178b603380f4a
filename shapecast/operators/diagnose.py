"""Residual diagnostics as sorts, windows and grouped aggregates.

Ranks over all rows are taken without one task sorting everything: rows are range-partitioned, ranked within partitions, and
shifted by the sizes of the partitions before.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.expr import diff, to_column
from ..plans.formula import expression
from .fit import Data, Model
from .predict import centiles, fixed_columns, parameter_columns, with_cdf, with_quantiles


def with_residuals(model: Model, data: DataFrame | None = None, type: str = "quantile", out: str = "z", seed: int | None = None) -> DataFrame:
    """data with residuals. quantile: Phi^-1(F(y)), at a random point of the jump for discrete families if seed is given, else at its middle; simple: (y - mu) / sigma."""
    df = model.data if data is None else data
    y = expression(model.response)
    if type == "simple" or model.family.name == "NO":  # the normal's quantile residual, without the errors of Phi and its inverse
        c = parameter_columns(model)
        return df.withColumn(out, (y - c["mu"]) / c.get("sigma", F.lit(1.0)))
    r = with_cdf(model, df, "__hi")
    if model.family.kind == "Discrete":
        lower = with_cdf(shifted(model), r, "__lo")
        u = F.rand(seed) if seed is not None else F.lit(0.5)
        r = lower.withColumn("__hi", F.col("__lo") + u * (F.col("__hi") - F.col("__lo"))).drop("__lo")
    p = F.least(F.greatest(F.col("__hi"), F.lit(1e-15)), F.lit(1 - 1e-15))
    return r.withColumn(out, dist.normal_quantile(p)).drop("__hi")


def shifted(model: Model) -> Model:
    """The model with its response one lower: for the CDF just below a count."""
    from dataclasses import replace

    designs = dict(model.designs)
    first = model.parameters[0]
    designs[first] = replace(designs[first], formula=replace(designs[first].formula, response=f"({model.response}) - 1"))
    return replace(model, designs=designs)


def _bucket(x: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are at or below x, by bisection; 0 for null."""
    if not bounds:
        return F.lit(0)
    every = F.array(*[F.lit(float(b)) for b in bounds])
    size = 1 << (len(bounds) - 1).bit_length()
    steps = [size >> k for k in range(size.bit_length())]
    at = lambda i: F.get(every, i - 1)
    found = F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), lambda a, k: F.when((a + k <= len(bounds)) & (at(a + k) <= x), a + k).otherwise(a))
    return F.coalesce(F.when(x.isNotNull(), found), F.lit(0))


def ranked(df: DataFrame, by: str | list[str], out: str = "rank", within: str | None = None) -> tuple[DataFrame, int | dict]:
    """df with the rank (from 1) of each row by columns, of which the first is a number, and the number of rows.

    Rows are dealt by approximate quantiles of the first column, which are constants of the plan, ranked there, and shifted
    by the sizes of the ranges before: no task sorts everything, and a range that is computed again has the same rows.
    within: a column with few values; ranks, and numbers of rows, are for each of them.
    """
    keys = [by] if isinstance(by, str) else list(by)
    group = [within] if within else []
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    x = F.col(keys[0]).cast("double")
    bounds = df.agg(F.percentile_approx(x, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    dealt = df.withColumn("__bucket", _bucket(x, sorted(set(bounds))))
    sizes = dealt.groupBy(*group, "__bucket").agg(F.count("*").alias("n")).collect()  # a row per range, and value of within
    before, total = [], {}
    for r in sorted(sizes, key=lambda r: r["__bucket"]):
        key = r[within] if within else None
        before.append(((r[within],) if within else ()) + (r["__bucket"], total.get(key, 0)))
        total[key] = total.get(key, 0) + r["n"]
    kind = f"{within} {df.schema[within].dataType.simpleString()}, " if within else ""
    shift = df.sparkSession.createDataFrame(before, f"{kind}__bucket int, __before long")
    w = W.partitionBy(*group, "__bucket").orderBy(*keys)
    made = dealt.join(F.broadcast(shift), [*group, "__bucket"]).withColumn(out, F.row_number().over(w) + F.col("__before"))
    return made.select(*df.columns, out), total if within else total.get(None, 0)


def moments(model: Model, data: DataFrame | None = None) -> dict[str, float]:
    """Mean, variance (n - 1), skewness and excess kurtosis of the quantile residuals."""
    r = with_residuals(model, data).agg(F.avg("z").alias("mean"), F.var_samp("z").alias("variance"), F.skewness("z").alias("skewness"), F.kurtosis("z").alias("kurtosis")).first()
    return r.asDict()


def qq_data(model: Model, data: DataFrame | None = None) -> DataFrame:
    """(rank, z, theoretical): plotting positions (i - 3/8) / (n + 1/4)."""
    r, n = ranked(with_residuals(model, data).select("z"), "z")
    return r.select("rank", "z", dist.normal_quantile((F.col("rank") - 0.375) / (n + 0.25)).alias("theoretical"))


def worm_data(model: Model, data: DataFrame | None = None, level: float = 0.95) -> DataFrame:
    """(rank, z, theoretical, deviation, band): the detrended QQ plot with its pointwise band."""
    r, n = ranked(with_residuals(model, data).select("z"), "z")
    t = dist.normal_quantile((F.col("rank") - 0.375) / (n + 0.25))
    p = dist.normal_cdf(F.col("theoretical"))
    out = r.select("rank", "z", t.alias("theoretical"))
    z = float(dist.q("NO", (1 + level) / 2, mu=0.0, sigma=1.0))
    return out.withColumn("deviation", F.col("z") - F.col("theoretical")).withColumn("band", z * F.sqrt(p * (1 - p) / n) / (F.exp(-F.col("theoretical") * F.col("theoretical") / 2) / math.sqrt(2 * math.pi)))


def cut(df: DataFrame, xvar: str, n_inter: int, how: str = "width", points=None) -> tuple[DataFrame, list[float]]:
    """df with `interval`: of equal width, or between quantiles, or at given points; the last one closed."""
    if points is None:
        if how == "width":
            lo, hi = df.agg(F.min(xvar), F.max(xvar)).first()
            points = [float(lo) + (float(hi) - float(lo)) * k / n_inter for k in range(1, n_inter)]
        else:
            points = df.agg(F.percentile_approx(xvar, [k / n_inter for k in range(1, n_inter)], 100_000)).first()[0]  # ranks within a 100,000th of the rows
    col = F.lit(1)
    for p in points:
        col = col + (F.col(xvar) >= F.lit(float(p))).cast("int")
    return df.withColumn("interval", col), list(points)


def worm_by(model: Model, xvar: str, n_inter: int = 4, data: DataFrame | None = None) -> DataFrame:
    """Worm data within intervals of xvar between quantiles."""
    df, _ = cut(with_residuals(model, data), xvar, n_inter, "quantile")
    r, n = ranked(df.select("interval", "z"), "z", within="interval")
    sizes = df.sparkSession.createDataFrame([(k, v) for k, v in n.items() if v >= 10], "interval int, n long")
    r = r.join(F.broadcast(sizes), "interval")
    return r.select("interval", "rank", "z", dist.normal_quantile((F.col("rank") - 0.375) / (F.col("n") + 0.25)).alias("theoretical")).withColumn("deviation", F.col("z") - F.col("theoretical"))


def q_stats(model: Model, xvar: str, n_inter: int = 10, data: DataFrame | None = None, points=None) -> DataFrame:
    """Per interval of xvar: n and Z1 to Z4 (mean, variance, skewness, kurtosis against a normal), and k2, z3 and z4 squared and added."""
    df, _ = cut(with_residuals(model, data), xvar, n_inter, "width", points)
    g = df.groupBy("interval").agg(F.count("*").alias("n"), F.avg("z").alias("m"), F.var_samp("z").alias("v"), F.skewness("z").alias("s"), (F.kurtosis("z") + 3).alias("k"))
    n = F.col("n").cast("double")  # a long's fourth power overflows from 41,800 rows
    z1, z2 = F.sqrt(n) * F.col("m"), (F.pow(F.col("v"), F.lit(1 / 3)) - (1 - 2 / (9 * n - 9))) / F.sqrt(2 / (9 * n - 9))
    y = F.col("s") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (b2 - 1))
    z3 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(F.log(F.sqrt(w2)))
    e = 3 * (n - 1) / (n + 1)
    v = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("k") - e) / F.sqrt(v)
    sb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / sb * (2 / sb + F.sqrt(1 + 4 / (sb * sb)))
    ratio = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z4 = ((1 - 2 / (9 * a)) - F.signum(ratio) * F.pow(F.abs(ratio), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    return g.where("n > 9").select("interval", "n", z1.alias("z1"), z2.alias("z2"), z3.alias("z3"), z4.alias("z4")).withColumn("k2", F.col("z3") * F.col("z3") + F.col("z4") * F.col("z4"))


def calibration(model: Model, data: DataFrame | None = None, n_bins: int = 10) -> DataFrame:
    """(bin, n, mean): bins of the CDF values and their means."""
    df = with_cdf(model, model.data if data is None else data, "__c")
    return df.groupBy(F.least(F.floor(F.col("__c") * n_bins), F.lit(n_bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("__c").alias("mean"))


def centile_check(model: Model, data: DataFrame | None = None, cent=(5, 25, 50, 75, 95)) -> DataFrame:
    """(centile, below): the percentage of responses at or below each predicted centile."""
    df = model.data if data is None else data
    w = with_quantiles(model, df, {c / 100: f"__c{k}" for k, c in enumerate(cent)})
    y = expression(model.response)
    row = w.agg(*[(100 * F.avg((y <= F.col(f"__c{k}")).cast("double"))).alias(str(k)) for k in range(len(cent))]).first()
    return df.sparkSession.createDataFrame([(float(c), row[str(k)]) for k, c in enumerate(cent)], "centile double, below double")


def centile_check_by(model: Model, xvar: str, n_inter: int = 4, data: DataFrame | None = None, cent=(5, 25, 50, 75, 95), points=None) -> DataFrame:
    """The same within intervals of xvar."""
    df, _ = cut(model.data if data is None else data, xvar, n_inter, "quantile", points)
    w = with_quantiles(model, df, {c / 100: f"__c{k}" for k, c in enumerate(cent)})
    y = expression(model.response)
    return w.groupBy("interval").agg(F.count("*").alias("n"), *[(100 * F.avg((y <= F.col(f"__c{k}")).cast("double"))).alias(f"below_{c:g}") for k, c in enumerate(cent)])


def row_weight(model: Model) -> Column:
    """Each row's information about the first parameter's predictor: the fit's working weight."""
    f, p = model.family, model.parameters[0]
    if f.logpdf is None:
        raise ValueError(f"{f.name} has no closed form to take row weights from")
    e = f.log_density_eta()
    u = diff(e, f"eta_{p}")
    values = {"y": expression(model.response), **{f"eta_{q}": c for q, c in parameter_columns(model, "link").items()}, **fixed_columns(model)}
    h, g = to_column(-diff(u, f"eta_{p}"), values), to_column(u, values)
    w = F.when(h > 1e-10, h).otherwise(F.greatest(g * g, F.lit(1e-10)))
    return w * F.col(model.weights).cast("double") if model.weights else w


def leverages(model: Model, data: DataFrame | None = None) -> DataFrame:
    """data with `leverage` of the first parameter's design: w x' (X' W X)^-1 x, w the row's working weight."""
    rows = Data(model.data, model.family, model.designs, model.weights, model.fixed, cache=False)
    p = model.parameters[0]
    inv = np.linalg.pinv(rows.sums(model.coefficients, (p,), working=True).info)
    cols = model.designs[p].columns
    h = F.lit(0.0)
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            h = h + F.lit(float(inv[i, j] * (1 if i == j else 2))) * a * cols[j]
    return (model.data if data is None else data).withColumn("leverage", F.least(row_weight(model) * h, F.lit(1 - 1e-9)))


def cooks_distance(model: Model, data: DataFrame | None = None) -> DataFrame:
    """data with `leverage` and `cooks`: z^2 / p * h / (1 - h), z the quantile residual."""
    k = len(model.designs[model.parameters[0]].columns)
    out = with_residuals(model, leverages(model, data))
    return out.withColumn("cooks", F.col("z") * F.col("z") / k * F.col("leverage") / (1 - F.col("leverage")))


def acf(df: DataFrame, value: str, order: str, max_lag: int = 10) -> DataFrame:
    """(lag, acf) of a column in an order: each range partition sees the rows just before it, so no task holds all rows."""
    base = df.select(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    r, n = ranked(base, "o")
    mean, var_ = base.agg(F.avg("v"), F.var_pop("v")).first()
    size = 100_000
    r = r.select((F.col("rank") - 1).alias("i"), (F.col("v") - F.lit(mean)).alias("v"))
    # blocks of rows, each with the max_lag rows after it once more
    blocks = r.withColumn("b", F.floor(F.col("i") / size)).unionByName(r.withColumn("b", F.floor(F.col("i") / size) - 1).where((F.col("i") % size < max_lag) & (F.col("b") >= 0)))
    w = W.partitionBy("b").orderBy("i")
    own = F.floor(F.col("i") / size) == F.col("b")
    lags = blocks.select("b", "i", "v", *[F.lead("v", k).over(w).alias(f"n{k}") for k in range(1, max_lag + 1)]).where(own)
    row = lags.agg(*[(F.sum(F.col("v") * F.col(f"n{k}")) / (n * var_)).alias(str(k)) for k in range(1, max_lag + 1)]).first()
    return df.sparkSession.createDataFrame([(k, row[str(k)]) for k in range(1, max_lag + 1)], "lag int, acf double")


def acf_residuals(model: Model, order: str, max_lag: int = 10, data: DataFrame | None = None) -> DataFrame:
    """(lag, acf, acf_squared) of the quantile residuals in the order of a column."""
    r = with_residuals(model, data)
    one = acf(r, "z", order, max_lag)
    two = acf(r.withColumn("z2", F.col("z") * F.col("z")), "z2", order, max_lag).withColumnRenamed("acf", "acf_squared")
    return one.join(two, "lag")


def term_data(model: Model, data: DataFrame | None = None, parameter: str = "mu") -> DataFrame:
    """data with the contribution of each term, named term_<label>."""
    d = model.designs[parameter]
    out = {}
    for b, sl in zip(d.blocks, d.slices(), strict=True):
        out[f"term_{b.label}"] = sum((F.lit(float(x)) * c for x, c in zip(model.coefficients[parameter][sl], b.columns, strict=True)), F.lit(0.0))
    return (model.data if data is None else data).withColumns(out)


def density_curve(model: Model, row: dict, n: int = 200, low: float | None = None, high: float | None = None) -> DataFrame:
    """(y, density) on a grid for one set of covariates."""
    spark = model.data.sparkSession
    one = spark.createDataFrame([row])
    if low is None or high is None:
        q = with_quantiles(model, one, {0.001: "__a", 0.999: "__b"}).first()
        low, high = (q["__a"] if low is None else low), (q["__b"] if high is None else high)
    params = one.select(*[c.alias(p) for p, c in parameter_columns(model).items()]).first().asDict()
    grid = spark.range(n).select((F.lit(float(low)) + F.col("id") * ((high - low) / (n - 1))).alias("y"))
    for p, v in params.items():
        grid = grid.withColumn(p, F.lit(float(v)))
    return dist.with_values(grid, model.family, "d", "y", "density", {p: p for p in params}).select("y", "density")


def histogram(data: DataFrame, column: str, family: str = "NO", n_bins: int = 20) -> DataFrame:
    """(bin, low, n, density) of a column with the mean fitted density of an intercept-only model in each bin (hist_dist)."""
    from .fit import gamlss

    m = gamlss(f"{column} ~ 1", data, family, vcov=False)
    lo, hi, n = data.agg(F.min(column), F.max(column), F.count(column)).first()
    width = (float(hi) - float(lo)) / n_bins or 1.0
    bins = data.where(F.col(column).isNotNull()).groupBy(F.least(F.floor((F.col(column) - float(lo)) / width), F.lit(n_bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    mid = bins.withColumn("low", float(lo) + F.col("bin") * width).withColumn("__y", F.col("low") + width / 2)
    for p, c in parameter_columns(m).items():
        mid = mid.withColumn(p, c)
    fitted = dist.with_values(mid, m.family, "d", "__y", "fitted", {p: p for p in m.parameters})
    return fitted.select("bin", "low", "n", (F.col("n") / (n * width)).alias("density"), "fitted")


def q_totals(stats: DataFrame, df_model: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0)) -> DataFrame:
    """(statistic, q, df, p): sums of the squares of Z1 to Z4 over the intervals of q_stats, against chi-square; df_model is taken off the number of intervals."""
    row = stats.agg(F.count("*").alias("n"), *[F.sum(F.col(f"z{k}") * F.col(f"z{k}")).alias(f"q{k}") for k in range(1, 5)]).first()
    out = []
    for k, used in enumerate(df_model, 1):
        q, df = float(row[f"q{k}"] or 0.0), max(row["n"] - used, 1.0)
        out.append((f"Q{k}", q, float(df), float(1 - dist.gammainc(df / 2, q / 2)) if q > 0 else 1.0))
    return stats.sparkSession.createDataFrame(out, "statistic string, q double, df double, p double")


def two_way_data(model: Model, terms: tuple[str, str], parameter: str = "mu", data: DataFrame | None = None) -> DataFrame:
    """(a, b, effect): mean of the summed contributions of two terms for each pair of their variables' values."""
    d = model.designs[parameter]
    labels = [b.label for b in d.blocks]
    unknown = [t for t in terms if t not in labels]
    if unknown:
        raise ValueError(f"no such terms: {unknown}; the model has {labels}")
    of = {t.label: t for t in d.formula.terms}
    a, b = (expression(of[t].args[0]) if of[t].kind != "factor" else F.col(of[t].args[0]) for t in terms)
    wide = term_data(model, data, parameter)
    return wide.groupBy(a.alias("a"), b.alias("b")).agg(F.avg(F.col(f"`term_{terms[0]}`") + F.col(f"`term_{terms[1]}`")).alias("effect"), F.count("*").alias("n"))


def centile_fan(model: Model, xvar: str, cent=(0.4, 2, 10, 25, 50, 75, 90, 98, 99.6), n: int = 100, fixed_values: dict | None = None) -> DataFrame:
    """(x, band, lower, upper, coverage): the bands between centiles that are symmetric about the median."""
    if any(abs(a + b - 100) > 1e-9 for a, b in zip(cent, reversed(cent), strict=True)):
        raise ValueError("the centiles aren't symmetric about 50")
    c = centiles(model, xvar, None, cent, fixed_values, n)
    name = lambda x: f"C{x:g}".replace(".", "_")
    bands = [F.struct(F.lit(i).alias("band"), F.col(name(a)).alias("lower"), F.col(name(b)).alias("upper"), F.lit(float(b - a)).alias("coverage")) for i, (a, b) in enumerate(zip(cent[: len(cent) // 2], reversed(cent), strict=False), 1)]
    return c.select(F.col(xvar).alias("x"), F.explode(F.array(*bands)).alias("b")).select("x", "b.*")


def centile_comparison(models: dict[str, Model], xvar: str, cent=(0.4, 10, 50, 90, 99.6), n: int = 100, fixed_values: dict | None = None) -> DataFrame:
    """(model, x, centile, value): the centile curves of several models."""
    out = None
    for label, m in models.items():
        c = centiles(m, xvar, None, cent, fixed_values, n)
        rows = F.array(*[F.struct(F.lit(float(x)).alias("centile"), F.col(f"C{x:g}".replace(".", "_")).alias("value")) for x in cent])
        part = c.select(F.lit(label).alias("model"), F.col(xvar).alias("x"), F.explode(rows).alias("c")).select("model", "x", "c.*")
        out = part if out is None else out.unionByName(part)
    return out


def centile_comparison_coverage(models: dict[str, Model], data: DataFrame | None = None, cent=(0.4, 10, 50, 90, 99.6)) -> DataFrame:
    """(centile, one column per model): the percentage of responses at or below each predicted centile."""
    out = None
    for label, m in models.items():
        part = centile_check(m, data, cent).withColumnRenamed("below", label)
        out = part if out is None else out.join(part, "centile")
    return out


def numerical_warnings(model: Model) -> list[dict]:
    """(level, code, message) of what looks wrong in a fit."""
    out = []

    def say(level: str, code: str, message: str) -> None:
        out.append({"level": level, "code": code, "message": message})

    if not model.converged:
        say("warning", "not_converged", f"stopped after {model.iterations} iterations")
    if not math.isfinite(model.deviance):
        say("error", "deviance", "the deviance isn't finite")
    if any(not np.isfinite(b).all() for b in model.coefficients.values()):
        say("error", "coefficients", "a coefficient isn't finite")
    if model.vcov is not None:
        d = np.diag(model.vcov)
        if (d <= 0).any() or not np.isfinite(d).all():
            say("warning", "information", "the information isn't positive definite")
        elif np.linalg.cond(model.vcov / np.sqrt(np.outer(d, d))) > 1e10:
            say("warning", "condition", "coefficients are nearly collinear")
    if model.df_fit >= model.n:
        say("warning", "saturated", "as many coefficients as rows")
    return out
