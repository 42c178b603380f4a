"""Symbolic real expressions: written once, differentiated exactly, compiled to Spark Columns or numpy.

A family states its log density as an expression. Scores and Hessians come from `diff`, and `to_column` turns all of them
into built-in Spark functions, so that a fit's sums stay inside generated code; `to_numpy` gives the same numbers for
Arrow batches and tests.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class E:
    """A node: op, args, and a value for constants or a name for variables."""

    __slots__ = ("args", "op", "val")

    def __init__(self, op: str, *args: E, val=None):
        self.op, self.args, self.val = op, args, val

    def __add__(self, o):
        return _add(self, wrap(o))

    def __radd__(self, o):
        return _add(wrap(o), self)

    def __sub__(self, o):
        return _add(self, -wrap(o))

    def __rsub__(self, o):
        return _add(wrap(o), -self)

    def __mul__(self, o):
        return _mul(self, wrap(o))

    def __rmul__(self, o):
        return _mul(wrap(o), self)

    def __truediv__(self, o):
        o = wrap(o)
        if o.op == "const":
            return _mul(self, const(1.0 / o.val))
        return ZERO if is_const(self, 0) else E("div", self, o)

    def __rtruediv__(self, o):
        return wrap(o) / self

    def __neg__(self):
        return const(-self.val) if self.op == "const" else E("neg", self)

    def __pow__(self, o):
        o = wrap(o)
        if is_const(o, 1):
            return self
        if is_const(o, 2):
            return self * self
        return E("pow", self, o)

    def __lt__(self, o):
        return E("lt", self, wrap(o))

    def __le__(self, o):
        return E("le", self, wrap(o))

    def __gt__(self, o):
        return E("lt", wrap(o), self)

    def __ge__(self, o):
        return E("le", wrap(o), self)

    def eq(self, o):
        return E("eq", self, wrap(o))

    def __and__(self, o):
        return E("and", self, o)


def const(x: float) -> E:
    return E("const", val=float(x))


def var(name: str) -> E:
    return E("var", val=name)


def wrap(x) -> E:
    return x if isinstance(x, E) else const(x)


ZERO, ONE = const(0), const(1)


def is_const(x: E, v: float) -> bool:
    return x.op == "const" and x.val == v


def _add(a: E, b: E) -> E:
    if a.op == b.op == "const":
        return const(a.val + b.val)
    return b if is_const(a, 0) else a if is_const(b, 0) else E("add", a, b)


def _mul(a: E, b: E) -> E:
    if a.op == b.op == "const":
        return const(a.val * b.val)
    if is_const(a, 0) or is_const(b, 0):
        return ZERO
    return b if is_const(a, 1) else a if is_const(b, 1) else E("mul", a, b)


def _unary(op: str):
    def make(x) -> E:
        x = wrap(x)
        if x.op == "const":  # folded here, so that constants cost nothing in generated code
            return const(float(to_numpy(E(op, x), {})))
        return E(op, x)

    make.__name__ = op
    return make


log, exp, sqrt, absolute = _unary("log"), _unary("exp"), _unary("sqrt"), _unary("abs")
log1p, expm1, asinh, sinh, cosh, tanh, atan, sin, cos = (_unary(x) for x in ("log1p", "expm1", "asinh", "sinh", "cosh", "tanh", "atan", "sin", "cos"))
lgamma, digamma, trigamma = _unary("lgamma"), _unary("digamma"), _unary("trigamma")
#: Phi and its logarithm.
ndtr, log_ndtr = _unary("ndtr"), _unary("log_ndtr")
ndtri, floor = _unary("ndtri"), _unary("floor")


def where(cond: E, a, b) -> E:
    if cond.op in ("lt", "le", "eq") and all(x.op == "const" for x in cond.args):
        return wrap(a) if bool(to_numpy(cond, {})) else wrap(b)
    return E("where", cond, wrap(a), wrap(b))


def maximum(a, b) -> E:
    a, b = wrap(a), wrap(b)
    return where(a < b, b, a)


def minimum(a, b) -> E:
    a, b = wrap(a), wrap(b)
    return where(a < b, a, b)


def clip(x, lo, hi) -> E:
    return maximum(minimum(x, hi), lo)


def betaln(a, b) -> E:
    return lgamma(a) + lgamma(b) - lgamma(wrap(a) + b)


def log_sum(a: E, b: E) -> E:
    """log(exp(a) + exp(b))"""
    return maximum(a, b) + log1p(exp(-absolute(a - b)))


SQRT_2PI = math.sqrt(2 * math.pi)
_DERIVATIVES = {
    "log": lambda x, e: 1 / x,
    "exp": lambda x, e: e,
    "sqrt": lambda x, e: 0.5 / e,
    "abs": lambda x, e: where(x < 0, -1, 1),
    "log1p": lambda x, e: 1 / (1 + x),
    "expm1": lambda x, e: e + 1,
    "asinh": lambda x, e: 1 / sqrt(1 + x * x),
    "sinh": lambda x, e: cosh(x),
    "cosh": lambda x, e: sinh(x),
    "tanh": lambda x, e: 1 - e * e,
    "atan": lambda x, e: 1 / (1 + x * x),
    "sin": lambda x, e: cos(x),
    "cos": lambda x, e: -sin(x),
    "lgamma": lambda x, e: digamma(x),
    "digamma": lambda x, e: trigamma(x),
    "ndtr": lambda x, e: exp(-0.5 * x * x) / SQRT_2PI,
    "log_ndtr": lambda x, e: exp(-0.5 * x * x - e) / SQRT_2PI,
    "floor": lambda x, e: ZERO,
}


def diff(e: E, name: str, memo: dict | None = None) -> E:
    """The derivative with respect to a variable; of a `where`, that of the branch taken."""
    memo = {} if memo is None else memo
    if id(e) in memo:
        return memo[id(e)][1]
    a = e.args
    if e.op in ("const", "lt", "le", "eq", "and"):
        out = ZERO
    elif e.op == "var":
        out = ONE if e.val == name else ZERO
    else:
        d = [diff(x, name, memo) for x in a]
        if all(is_const(x, 0) for x in d):
            out = ZERO
        elif e.op == "add":
            out = d[0] + d[1]
        elif e.op == "neg":
            out = -d[0]
        elif e.op == "mul":
            out = d[0] * a[1] + a[0] * d[1]
        elif e.op == "div":
            out = (d[0] - e * d[1]) / a[1]
        elif e.op == "pow":
            out = ZERO
            if not is_const(d[0], 0):
                out = out + a[1] * a[0] ** (a[1] - 1) * d[0]
            if not is_const(d[1], 0):
                out = out + e * log(a[0]) * d[1]
        elif e.op == "where":
            out = where(a[0], d[1], d[2])
        else:
            out = _DERIVATIVES[e.op](a[0], e) * d[0]
    memo[id(e)] = (e, out)  # keeps e alive, so that its id stays its own
    return out


# --- special functions over whatever has log, exp, where and arithmetic -------------------------------------------------

#: Coefficients of the asymptotic series (Bernoulli numbers), from the literature.
LGAMMA_SERIES = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188]
DIGAMMA_SERIES = [1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132]
TRIGAMMA_SERIES = [1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66]
#: Rational approximations of erfc by W. J. Cody (1969), for |x| < 0.46875, up to 4 and beyond.
ERF_A = [3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1]
ERF_B = [2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03]
ERF_C = [5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8]
ERF_D = [1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03]
ERF_P = [3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2]
ERF_Q = [2.56852019228982242e00, 1.87295284992346047e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]
#: Rational approximation of the normal quantile by P. J. Acklam, refined by one Newton step.
ACKLAM_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
ACKLAM_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]


def horner(c, x):
    out = c[0]
    for k in c[1:]:
        out = out * x + k
    return out


class Numpy:
    log, exp, sqrt, abs, floor = np.log, np.exp, np.sqrt, np.abs, np.floor
    where = staticmethod(np.where)

    @staticmethod
    def minimum(a, b):
        return np.minimum(a, b)

    @staticmethod
    def maximum(a, b):
        return np.maximum(a, b)


class Spark:
    log, exp, sqrt, abs = staticmethod(F.log), staticmethod(F.exp), staticmethod(F.sqrt), staticmethod(F.abs)

    @staticmethod
    def floor(x):
        return F.floor(x).cast("double")

    @staticmethod
    def where(c, a, b):
        lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
        return F.when(c, lit(a)).otherwise(lit(b))

    @staticmethod
    def minimum(a, b):
        return F.least(*[x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b)])

    @staticmethod
    def maximum(a, b):
        return F.greatest(*[x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b)])


def special_lgamma(m, x):
    """log Gamma for x > 0: shifted to 8 or more, then Stirling's series."""
    p = x * (x + 1.0) * (x + 2.0) * (x + 3.0) * (x + 4.0) * (x + 5.0) * (x + 6.0) * (x + 7.0)
    small = x < 8.0
    z = m.where(small, x + 8.0, x)
    r = 1.0 / z
    out = (z - 0.5) * m.log(z) - z + 0.5 * math.log(2 * math.pi) + r * horner(LGAMMA_SERIES[::-1], r * r)
    return out - m.where(small, m.log(m.where(small, p, 1.0)), 0.0)


def special_digamma(m, x):
    small = x < 8.0
    z = m.where(small, x + 8.0, x)
    r = 1.0 / (z * z)
    out = m.log(z) - 0.5 / z - r * horner(DIGAMMA_SERIES[::-1], r)
    low = m.where(small, x, 1.0)
    return out - m.where(small, sum(1.0 / (low + float(k)) for k in range(8)), 0.0)


def special_trigamma(m, x):
    small = x < 8.0
    z = m.where(small, x + 8.0, x)
    r = 1.0 / (z * z)
    out = 1.0 / z + 0.5 * r + r / z * horner(TRIGAMMA_SERIES[::-1], r)
    low = m.where(small, x, 1.0)
    return out + m.where(small, sum(1.0 / ((low + float(k)) * (low + float(k))) for k in range(8)), 0.0)


def _erfc_parts(m, a):
    """erf(a) for a < 0.46875, and erfc(a) * exp(a * a) beyond, for a >= 0."""
    t = a * a
    s = m.minimum(t, 0.2197265625)
    low = m.minimum(a, 0.46875) * horner([ERF_A[4], *ERF_A[:4]], s) / horner([1.0, *ERF_B], s)
    b = m.minimum(a, 4.0)
    mid = horner([ERF_C[8], *ERF_C[:8]], b) / horner([1.0, *ERF_D], b)
    c = m.maximum(a, 4.0)
    r = 1.0 / (c * c)
    far = (1 / math.sqrt(math.pi) - r * horner([ERF_P[5], *ERF_P[:5]], r) / horner([1.0, *ERF_Q], r)) / c
    return low, m.where(a <= 4.0, mid, far)


def special_ndtr(m, x):
    a = m.abs(x) * math.sqrt(0.5)
    low, high = _erfc_parts(m, a)
    tail = 0.5 * high * m.exp(-(a * a))
    return m.where(a < 0.46875, m.where(x < 0.0, 0.5 - 0.5 * low, 0.5 + 0.5 * low), m.where(x < 0.0, tail, 1.0 - tail))


def special_log_ndtr(m, x):
    a = m.abs(x) * math.sqrt(0.5)
    _, high = _erfc_parts(m, a)
    far = x < -1.0
    return m.where(far, m.log(m.where(far, 0.5 * high, 1.0)) - a * a, m.log(m.where(far, 1.0, special_ndtr(m, x))))


def special_ndtri(m, p):
    """Normal quantile: Acklam's rational form, and in numpy one Halley step."""
    q = m.minimum(p, 1.0 - p)
    tail = m.sqrt(-2.0 * m.log(m.minimum(q, 0.02425)))
    x_tail = horner(ACKLAM_C, tail) / horner([*ACKLAM_D, 1.0], tail)
    d = m.maximum(q, 0.02425) - 0.5
    r = d * d
    x_mid = horner(ACKLAM_A, r) * d / horner([*ACKLAM_B, 1.0], r)
    x = m.where(q < 0.02425, x_tail, x_mid)
    if m is Spark:  # 1e-9 without the step, which as one Column would be a very large expression
        return m.where(p < 0.5, x, -x)
    u = (special_ndtr(m, x) - q) * SQRT_2PI * m.exp(0.5 * x * x)
    x = x - u / (1.0 + 0.5 * x * u)
    return m.where(p < 0.5, x, -x)


_SPECIAL = {"lgamma": special_lgamma, "digamma": special_digamma, "trigamma": special_trigamma, "ndtr": special_ndtr, "log_ndtr": special_log_ndtr, "ndtri": special_ndtri}
_DERIVATIVES["ndtri"] = lambda x, e: SQRT_2PI * exp(0.5 * e * e)
_SPARK = {"log": F.log, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs, "log1p": F.log1p, "expm1": F.expm1, "asinh": F.asinh, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "atan": F.atan, "sin": F.sin, "cos": F.cos, "floor": Spark.floor}
_NUMPY = {"log": np.log, "exp": np.exp, "sqrt": np.sqrt, "abs": np.abs, "log1p": np.log1p, "expm1": np.expm1, "asinh": np.arcsinh, "sinh": np.sinh, "cosh": np.cosh, "tanh": np.tanh, "atan": np.arctan, "sin": np.sin, "cos": np.cos, "floor": np.floor}


def _compiled(e: E, values: dict, memo: dict, table: dict, m, literal, power):
    if id(e) in memo:
        return memo[id(e)][1]
    if e.op == "const":
        out = literal(e.val)
    elif e.op == "var":
        out = values[e.val]
    else:
        a = [_compiled(x, values, memo, table, m, literal, power) for x in e.args]
        if e.op == "add":
            out = a[0] + a[1]
        elif e.op == "mul":
            out = a[0] * a[1]
        elif e.op == "div":
            out = a[0] / a[1]
        elif e.op == "neg":
            out = -a[0]
        elif e.op == "pow":
            out = power(a[0], a[1])
        elif e.op == "lt":
            out = a[0] < a[1]
        elif e.op == "le":
            out = a[0] <= a[1]
        elif e.op == "eq":
            out = a[0] == a[1]
        elif e.op == "and":
            out = a[0] & a[1]
        elif e.op == "where":
            out = m.where(*a)
        elif e.op in _SPECIAL:
            out = _SPECIAL[e.op](m, a[0])
        else:
            out = table[e.op](a[0])
    memo[id(e)] = (e, out)
    return out


def to_column(e: E, values: dict[str, Column], memo: dict | None = None) -> Column:
    return _compiled(e, values, {} if memo is None else memo, _SPARK, Spark, F.lit, F.pow)


def to_numpy(e: E, values: dict[str, np.ndarray], memo: dict | None = None) -> np.ndarray:
    with np.errstate(all="ignore"):
        return _compiled(e, values, {} if memo is None else memo, _NUMPY, Numpy, lambda x: x, np.power)
