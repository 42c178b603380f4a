"""d, p, q and r of every family: as Columns where a closed form exists, as Arrow batches otherwise, and in numpy.

p and q have lower_tail and log_p; d has log. Values outside the support have density 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import Numpy, Spark, const, special_lgamma, special_ndtr, special_ndtri, to_column, to_numpy, var
from .families import Family, resolve


def gammainc(a, x):
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.maximum(np.asarray(x, float), 0.0))
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - special_lgamma(Numpy, a))
        term = total = 1.0 / a
        most = 2000 + int(20 * math.sqrt(np.nan_to_num(a, nan=0.0, posinf=0.0).max(initial=0.0)))  # terms grow with the root of a
        for k in range(1, most):
            term = term * x / (a + k)
            total = total + term
            if np.all((np.abs(term) < 1e-16 * np.abs(total)) | (x >= a + 1)):
                break
        b = x + 1.0 - a
        c, d = np.full(a.shape, 1e300), 1.0 / np.where(b == 0, 1e-300, b)
        h = d
        for k in range(1, most):
            an = -k * (k - a)
            b = b + 2.0
            d = 1.0 / (an * d + b)
            c = b + an / c
            h = h * d * c
            if np.all((np.abs(d * c - 1) < 1e-15) | (x < a + 1)):
                break
        out = np.where(x < a + 1, front * total, 1.0 - front * h)
    return np.where(x <= 0, 0.0, np.clip(out, 0.0, 1.0))


def betainc(a, b, x):
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0.0, 1.0)
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(all="ignore"):
        lg = lambda v: special_lgamma(Numpy, v)
        front = np.exp(lg(a + b) - lg(a) - lg(b) + p * np.log(np.maximum(z, 1e-300)) + q * np.log1p(-z)) / p
        c, d = np.ones_like(z), 1.0 / (1 - (p + q) * z / (p + 1))
        h = d
        for m in range(1, 1000 + int(20 * math.sqrt(np.nan_to_num(np.maximum(a, b), nan=0.0, posinf=0.0).max(initial=0.0)))):
            e = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            d = 1 / (1 + e * d)
            c = 1 + e / c
            h = h * d * c
            e = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            d = 1 / (1 + e * d)
            c = 1 + e / c
            h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
    out = np.where(z <= 0, 0.0, front * h)
    return np.clip(np.where(flip, 1 - out, out), 0.0, 1.0)


def student_cdf(z, df):
    half = 0.5 * betainc(df / 2, 0.5, df / (df + z * z))
    return np.where(z > 0, 1 - half, half)


def pe_cdf(z, nu):
    lg = lambda v: special_lgamma(Numpy, v)
    c = np.exp(0.5 * (-(2 / nu) * math.log(2) + lg(1 / nu) - lg(3 / nu)))
    return 0.5 + 0.5 * np.sign(z) * gammainc(1 / nu, 0.5 * np.abs(z / c) ** nu)


def _bc_z(y, mu, sigma, nu):
    near = np.abs(nu) < 1e-6
    v = np.where(near, 1.0, nu)
    return np.where(near, np.log(y / mu), ((y / mu) ** v - 1) / v) / sigma


def _be_cdf(y, mu, sigma):
    k = (1 - sigma**2) / sigma**2
    return betainc(mu * k, (1 - mu) * k, y)


def _ga_cdf(y, mu, sigma):
    return gammainc(1 / sigma**2, y / (mu * sigma**2))


#: CDFs by incomplete gamma and beta functions.
NUMPY_CDF = {
    "GA": _ga_cdf,
    "PO": lambda y, mu: 1 - gammainc(np.floor(y) + 1, mu),
    "NBI": lambda y, mu, sigma: betainc(1 / sigma, np.floor(y) + 1, 1 / (1 + mu * sigma)),
    "NBII": lambda y, mu, sigma: betainc(mu / sigma, np.floor(y) + 1, 1 / (1 + sigma)),
    "BE": _be_cdf,
    "TF": lambda y, mu, sigma, nu: student_cdf((y - mu) / sigma, nu),
    "PE": lambda y, mu, sigma, nu: pe_cdf((y - mu) / sigma, nu),
    "BCT": lambda y, mu, sigma, nu, tau: student_cdf(_bc_z(y, mu, sigma, nu), tau),
    "BCPE": lambda y, mu, sigma, nu, tau: pe_cdf(_bc_z(y, mu, sigma, nu), tau),
    "GG": lambda y, mu, sigma, nu: gammainc(1 / (sigma * nu) ** 2, (y / mu) ** nu / (sigma * nu) ** 2),
    "IGAMMA": lambda y, mu, sigma: 1 - gammainc(1 / sigma**2, mu * (1 / sigma**2 + 1) / y),
    "GB2": lambda y, mu, sigma, nu, tau: betainc(nu, tau, 1 / (1 + (y / mu) ** -sigma)),
    "ZAGA": lambda y, mu, sigma, nu: nu + (1 - nu) * _ga_cdf(y, mu, sigma),
    "BEINF": lambda y, mu, sigma, nu, tau: np.where(y >= 1, 1.0, (nu + _be_cdf(y, mu, sigma)) / (1 + nu + tau)),
    "ZIP": lambda y, mu, sigma: sigma + (1 - sigma) * (1 - gammainc(np.floor(y) + 1, mu)),
}
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)
_NODES, _WEIGHTS = (_NODES + 1) / 2, _WEIGHTS / 2


def _arrays(*xs):
    return [np.array(x, float) for x in np.broadcast_arrays(*(np.asarray(x, float) for x in xs))]


def in_support(f: Family, y):
    if f.support == "real":
        return np.isfinite(y)
    if f.support == "unit":
        low = y >= 0 if f.name in ("BEINF", "BEINF0", "BEZI") else y > 0
        return low & (y <= 1 if f.name in ("BEINF", "BEINF1", "BEOI") else y < 1)
    if f.support == "positive":
        return y >= 0 if f.kind == "Mixed" else y > 0
    if f.support == "above1":
        return y > 1
    return (y >= (1 if f.support == "count1" else 0)) & np.isfinite(y)


def d(family, y, log: bool = False, **params):
    """Density, or log density."""
    f = resolve(family)
    names = [*params]
    y, *values = _arrays(y, *params.values())
    q = dict(zip(names, values, strict=True)) | {k: np.full(y.shape, v) for k, v in f.fixed.items() if k not in params}
    ok = in_support(f, y)
    safe = np.where(ok, y, 0.5 if f.support == "unit" else 2.0)
    out = f.np_logpdf(safe, **q) if f.np_logpdf else to_numpy(f.log_density(), {"y": safe, **q})
    out = np.where(ok, out + np.zeros(y.shape), -np.inf)
    return out if log else np.exp(out)


def _numeric_cdf(f: Family, y, q):
    if f.kind == "Discrete":
        flat, par = np.floor(y).ravel(), {k: np.broadcast_to(v, y.shape).ravel() for k, v in q.items()}
        out, left, at = np.where(flat == np.inf, 1.0, 0.0), np.flatnonzero(np.isfinite(flat)), 1.0 if f.support == "count1" else 0.0
        while len(left := left[(flat[left] >= at) & (out[left] < 1 - 1e-15)]):  # a run of counts at a time, only for rows that need it
            k = at + np.arange(max(16, min(4096, 200_000 // len(left))))
            part = d(f, np.broadcast_to(k, (len(left), len(k))), **{n: v[left, None] for n, v in par.items()})
            out[left] += np.where(k <= flat[left, None], part, 0.0).sum(axis=1)
            at = k[-1] + 1
        return np.clip(out, 0, 1).reshape(y.shape)
    mass = 0.0
    if f.kind == "Mixed" and f.name not in ("BEOI", "BEINF1"):
        mass = d(f, np.zeros(y.shape), **q)
    if f.support == "real":
        scale = np.maximum(np.abs(q.get("sigma", np.ones(y.shape))), 1e-12)[..., None]
        u = _NODES / (1 - _NODES)
        points, weight = y[..., None] - scale * u, _WEIGHTS / (1 - _NODES) ** 2 * scale
    else:
        low = 1.0 if f.support == "above1" else 0.0
        points, weight = low + (np.minimum(y, 1.0 - 1e-12) if f.support == "unit" else y)[..., None] * _NODES**3 - low * _NODES**3, _WEIGHTS * 3 * _NODES**2 * (y - low)[..., None]
    dens = d(f, points, **{k: np.asarray(v)[..., None] for k, v in q.items()})
    out = mass + (dens * weight).sum(axis=-1)
    out = np.where(y >= 1, 1.0, out) if f.support == "unit" else out
    return np.clip(np.where(y < 0, 0.0, out) if f.support != "real" else out, 0, 1)


def p(family, y, lower_tail: bool = True, log_p: bool = False, **params):
    """Cumulative distribution function."""
    f = resolve(family)
    names = [*params]
    y, *values = _arrays(y, *params.values())
    q = dict(zip(names, values, strict=True)) | {k: np.full(y.shape, v) for k, v in f.fixed.items() if k not in params}
    low = {"real": -np.inf, "above1": 1.0, "count1": 1.0}.get(f.support, 0.0)
    if f.cdf or f.name in NUMPY_CDF:
        safe = np.maximum(y, low if f.kind == "Discrete" else max(low, 1e-300)) if f.support != "real" else y
        safe = np.minimum(safe, 1.0 if f.name == "BEINF" else 1 - 1e-15) if f.support == "unit" else safe
        with np.errstate(all="ignore"):
            out = NUMPY_CDF[f.name](safe, **q) if f.name in NUMPY_CDF else to_numpy(f.cdf(var("y"), **{k: var(k) for k in q}), {"y": safe, **q})
        out = np.where(y < low, 0.0, out) if f.support != "real" else out + np.zeros(y.shape)
    else:
        out = _numeric_cdf(f, y, q)
    out = out if lower_tail else 1 - out
    return np.log(out) if log_p else out


def q(family, prob, lower_tail: bool = True, log_p: bool = False, **params):
    """Quantile: the smallest value whose CDF reaches the probability."""
    f = resolve(family)
    names = [*params]
    prob, *values = _arrays(prob, *params.values())
    prob = np.exp(prob) if log_p else prob
    prob = prob if lower_tail else 1 - prob
    par = dict(zip(names, values, strict=True))
    if f.quantile:
        return to_numpy(f.quantile(var("p"), **{k: var(k) for k in f.parameters}), {"p": prob, **par}) + np.zeros(prob.shape)
    if f.kind == "Discrete":
        lo, hi = np.full(prob.shape, -1.0), np.full(prob.shape, 1.0)
        for _ in range(60):
            short = p(f, hi, **par) < prob
            if not short.any():
                break
            lo, hi = np.where(short, hi, lo), np.where(short, hi * 2, hi)
        while np.any(hi - lo > 1):
            mid = np.floor((lo + hi) / 2)
            ok = p(f, mid, **par) >= prob
            lo, hi = np.where(ok, lo, mid), np.where(ok, mid, hi)
        return hi
    if f.support == "unit":
        lo, hi = np.zeros(prob.shape), np.ones(prob.shape)
    else:
        at, scale = par.get("mu", np.zeros(prob.shape)), np.maximum(par.get("sigma", np.ones(prob.shape)), 1e-6)
        scale = np.maximum(scale, np.abs(at) * 0.1) if f.support != "real" else scale
        lo = np.zeros(prob.shape) if f.support != "real" else at - scale
        hi = np.abs(at) + scale if f.support != "real" else at + scale
        for _ in range(60):
            low, high = (p(f, lo, **par) > prob) & (f.support == "real"), p(f, hi, **par) < prob
            if not (low.any() or high.any()):
                break
            width = hi - lo
            lo, hi = np.where(low, lo - width, lo), np.where(high, hi + width, hi)
    for _ in range(60):
        mid = (lo + hi) / 2
        ok = p(f, mid, **par) >= prob
        lo, hi = np.where(ok, lo, mid), np.where(ok, mid, hi)
    return hi


def r(family, n: int, seed: int = 0, **params):
    """n draws by inversion; the same seed gives the same draws."""
    return q(family, np.random.default_rng(seed).random(n), **{k: np.broadcast_to(np.asarray(v, float), (n,)) for k, v in params.items()})


# --- over DataFrames ----------------------------------------------------------------------------------------------------


def density_column(family, y: Column, params: dict[str, Column], log: bool = True) -> Column:
    f = resolve(family)
    if f.logpdf is None:
        raise ValueError(f"{f.name} has no closed form; use with_values")
    out = to_column(f.log_density(), {"y": y, **params, **{k: F.lit(v) for k, v in f.fixed.items() if k not in params}})
    return out if log else F.exp(out)


def cdf_column(family, y: Column, params: dict[str, Column]) -> Column | None:
    """None where the family has no closed CDF."""
    f = resolve(family)
    if f.cdf is None:
        return None
    return to_column(f.cdf(var("y"), **{k: var(k) for k in (*f.parameters, *f.fixed) if k in params}), {"y": y, **params})


def quantile_column(family, prob: Column | float, params: dict[str, Column]) -> Column | None:
    """A probability given as a number is folded into constants."""
    f = resolve(family)
    if f.quantile is None:
        return None
    if not isinstance(prob, Column):
        return to_column(f.quantile(const(prob), **{k: var(k) for k in f.parameters}), dict(params))
    return to_column(f.quantile(var("p"), **{k: var(k) for k in f.parameters}), {"p": prob, **params})


def with_values(df: DataFrame, family, what: str, x: str, out: str, params: dict[str, str], seed: int = 0) -> DataFrame:
    """df with d, log d, p or q of column x ("d", "logd", "p", "q"), or a draw ("r", by the uniform column x), in column out.

    params: parameter -> column. Closed forms become Columns; the rest goes through Arrow batches, without a shuffle.
    """
    f = resolve(family)
    cols = {k: F.col(v).cast("double") for k, v in params.items()}
    xc = F.col(x).cast("double")
    made = None
    if what in ("d", "logd") and f.logpdf is not None:
        made = density_column(f, xc, cols, what == "logd")
    elif what == "p":
        made = cdf_column(f, xc, cols)
    elif what in ("q", "r"):
        made = quantile_column(f, xc, cols)
    if made is not None:
        return df.withColumn(out, made)
    names, kind = [*params], what

    def value(x, *ps):
        par = {k: s.to_numpy() for k, s in zip(names, ps, strict=True)}
        fn = {"d": lambda: d(f, x, **par), "logd": lambda: d(f, x, log=True, **par), "p": lambda: p(f, x, **par), "q": lambda: q(f, x, **par), "r": lambda: q(f, x, **par)}[kind]
        return pd.Series(fn())

    value.__annotations__ = {"x": pd.Series, "ps": pd.Series, "return": pd.Series}
    return df.withColumn(out, F.pandas_udf(value, "double")(xc, *cols.values()))


def normal_cdf(x: Column) -> Column:
    return special_ndtr(Spark, x)


def normal_quantile(x: Column) -> Column:
    return special_ndtri(Spark, x)
