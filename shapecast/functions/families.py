"""Response families: log densities as expressions, with CDFs and quantiles where a closed form exists.

Names and parameterisations follow the usual GAMLSS notation (Rigby and Stasinopoulos). Everything else is derived: scores
and Hessians by symbolic differentiation, missing CDFs and quantiles numerically in `dist`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from typing import Callable

import numpy as np

from .expr import E, Numpy, absolute, asinh, betaln, clip, cosh, exp, floor, lgamma, log, log1p, log_ndtr, log_sum, maximum, minimum, ndtr, ndtri, sinh, special_lgamma, sqrt, tanh, var, where, wrap
from .links import Link, get_link

LOG_2PI = math.log(2 * math.pi)
PARAMETERS = ("mu", "sigma", "nu", "tau")


@dataclass(frozen=True)
class Family:
    """A response distribution. `logpdf`, `cdf` and `quantile` take expressions; `np_*` are numpy where there is no expression.

    start: from the response's moments (dict m, v, m0: mean, variance, share of zeros ...) to starting values.
    """

    name: str
    kind: str
    links: dict[str, str]
    logpdf: Callable[..., E] | None
    support: str = "real"
    cdf: Callable[..., E] | None = None
    quantile: Callable[..., E] | None = None
    mean: Callable[..., E] | None = None
    variance: Callable[..., E] | None = None
    start: Callable[[dict], dict] | None = None
    np_logpdf: Callable[..., np.ndarray] | None = None
    np_cdf: Callable[..., np.ndarray] | None = None
    fixed: dict[str, float] = field(default_factory=dict)
    status: str = "stable"

    @property
    def parameters(self) -> tuple[str, ...]:
        return tuple(self.links)

    def link(self, parameter: str) -> Link:
        return get_link(self.links[parameter])

    def log_density(self) -> E:
        """Over the variables y, the parameters and the fixed ones."""
        return self.logpdf(var("y"), **{p: var(p) for p in (*self.links, *self.fixed)})

    def log_density_eta(self) -> E:
        """The same over the predictors eta_<parameter>."""
        inv = {p: self.link(p).inverse(var(f"eta_{p}")) for p in self.links}
        return self.logpdf(var("y"), **inv, **{p: var(p) for p in self.fixed})

    def with_links(self, **links: str) -> Family:
        for p, x in links.items():
            if p not in self.links:
                raise ValueError(f"{self.name} has no parameter {p!r}")
            get_link(x)
        return replace(self, links=self.links | links)


_REGISTRY: dict[str, Family] = {}


def register(name: str, family: Family | Callable[[], Family]) -> None:
    _REGISTRY[name.upper()] = family() if callable(family) and not isinstance(family, Family) else family


def resolve(family: str | Family | None) -> Family:
    """A family by name, case-insensitive; None is NO."""
    if isinstance(family, Family):
        return family
    key = (family or "NO").upper()
    if key not in _REGISTRY:
        raise ValueError(f"unknown family {family!r}; known: {list_families()}")
    return _REGISTRY[key]


def list_families() -> list[str]:
    return sorted(f.name for f in _REGISTRY.values())


def _f(name: str, kind: str, links: str, logpdf, support: str = "real", **more) -> None:
    register(name, Family(name, kind, dict(x.split(":") for x in links.split()), logpdf, support, **more))


# --- building blocks ----------------------------------------------------------------------------------------------------


def n_(y, mu, sigma):
    z = (y - mu) / sigma
    return -0.5 * LOG_2PI - log(sigma) - 0.5 * z * z


def gamma_(y, shape, scale):
    return (shape - 1) * log(y) - y / scale - lgamma(shape) - shape * log(scale)


def ga_(y, mu, sigma):
    a = 1 / (sigma * sigma)
    return gamma_(y, a, mu * sigma * sigma)


def ig_(y, mu, sigma):
    return -0.5 * LOG_2PI - log(sigma) - 1.5 * log(y) - (y - mu) * (y - mu) / (2 * mu * mu * sigma * sigma * y)


def beta_(y, a, b):
    return (a - 1) * log(y) + (b - 1) * log(1 - y) - betaln(a, b)


def be_(y, mu, sigma):
    k = (1 - sigma * sigma) / (sigma * sigma)
    return beta_(y, mu * k, (1 - mu) * k)


def po_(y, mu):
    return y * log(mu) - mu - lgamma(y + 1)


def nb_(y, mu, size):
    return lgamma(y + size) - lgamma(size) - lgamma(y + 1) + size * log(size / (size + mu)) + y * log(mu / (size + mu))


def nbi_(y, mu, sigma):
    return nb_(y, mu, 1 / sigma)


def t_(z, df):
    return lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * log(df * math.pi) - (df + 1) / 2 * log1p(z * z / df)


def pe_(z, nu):
    """Power exponential with variance 1."""
    c = 0.5 * (-(2 / nu) * math.log(2) + lgamma(1 / nu) - lgamma(3 / nu))
    return log(nu) - c - (1 + 1 / nu) * math.log(2) - lgamma(1 / nu) - 0.5 * (absolute(z) / exp(c)) ** nu


def jsu_(z, nu, tau):
    r = nu + tau * asinh(z)
    return log(tau) - 0.5 * LOG_2PI - 0.5 * log1p(z * z) - 0.5 * r * r


def zero(y):
    return y <= 0


def zero_altered(log_f, at_zero, p):
    """Mass p at 0, and a density of the positive values."""
    return lambda y, **q: where(zero(y), log(q[p]), log(1 - q[p]) + log_f(where(zero(y), 1.0, y), **{k: v for k, v in q.items() if k != p}) - (log1p(-exp(at_zero(**{k: v for k, v in q.items() if k != p}))) if at_zero else 0.0))


def zero_inflated_(log_f, p):
    def make(y, **q):
        rest = {k: v for k, v in q.items() if k != p}
        base = log_f(y, **rest)
        return where(zero(y), log_sum(log(q[p]), log(1 - q[p]) + log_f(wrap(0.0), **rest)), log(1 - q[p]) + base)

    return make


def box_cox(y, mu, sigma, nu):
    """(z, log |dz/dy|) of the transformation of y / mu."""
    near = absolute(nu) < 1e-6
    safe = where(near, 1.0, nu)
    r = log(y / mu)
    z = where(near, r, (exp(safe * r) - 1) / safe) / sigma
    return z, (nu - 1) * log(y) - nu * log(mu) - log(sigma)


def _lo(y, mu, sigma):
    z = (y - mu) / sigma
    a = absolute(z)
    return -a - 2 * log1p(exp(-a)) - log(sigma)


def sd(s):
    return math.sqrt(max(s["v"], 1e-12))


def cv(s):
    return min(max(sd(s) / max(abs(s["m"]), 1e-12), 1e-3), 10.0)


def over(s):
    return min(max((s["v"] - s["m"]) / max(s["m"] ** 2, 1e-12), 0.05), 10.0)


def unit(x):
    return min(max(x, 0.01), 0.99)


loc = lambda s, **k: {"mu": s["m"], "sigma": sd(s), **k}
pos = lambda s, **k: {"mu": max(s["m"], 1e-6), "sigma": cv(s), **k}

# --- continuous on the real line ----------------------------------------------------------------------------------------
_f("NO", "Continuous", "mu:identity sigma:log", n_, cdf=lambda y, mu, sigma: ndtr((y - mu) / sigma), quantile=lambda p, mu, sigma: mu + sigma * ndtri(p), mean=lambda mu, sigma: mu, variance=lambda mu, sigma: sigma * sigma, start=loc)
_f("NO2", "Continuous", "mu:identity sigma:log", lambda y, mu, sigma: n_(y, mu, sqrt(sigma)), cdf=lambda y, mu, sigma: ndtr((y - mu) / sqrt(sigma)), quantile=lambda p, mu, sigma: mu + sqrt(sigma) * ndtri(p), start=lambda s: {"mu": s["m"], "sigma": max(s["v"], 1e-9)})
_f("LO", "Continuous", "mu:identity sigma:log", _lo, cdf=lambda y, mu, sigma: 1 / (1 + exp(-(y - mu) / sigma)), quantile=lambda p, mu, sigma: mu + sigma * log(p / (1 - p)), mean=lambda mu, sigma: mu, start=lambda s: {"mu": s["m"], "sigma": 0.55 * sd(s)})
_f("GU", "Continuous", "mu:identity sigma:log", lambda y, mu, sigma: (y - mu) / sigma - exp((y - mu) / sigma) - log(sigma), cdf=lambda y, mu, sigma: 1 - exp(-exp((y - mu) / sigma)), quantile=lambda p, mu, sigma: mu + sigma * log(-log(1 - p)), start=lambda s: {"mu": s["m"] + 0.45 * sd(s), "sigma": 0.78 * sd(s)})
_f("RG", "Continuous", "mu:identity sigma:log", lambda y, mu, sigma: -(y - mu) / sigma - exp(-(y - mu) / sigma) - log(sigma), cdf=lambda y, mu, sigma: exp(-exp(-(y - mu) / sigma)), quantile=lambda p, mu, sigma: mu - sigma * log(-log(p)), start=lambda s: {"mu": s["m"] - 0.45 * sd(s), "sigma": 0.78 * sd(s)})
_f("TF", "Continuous", "mu:identity sigma:log nu:log", lambda y, mu, sigma, nu: t_((y - mu) / sigma, nu) - log(sigma), mean=lambda mu, sigma, nu: mu, start=lambda s: loc(s, nu=10.0))
_f("PE", "Continuous", "mu:identity sigma:log nu:log", lambda y, mu, sigma, nu: pe_((y - mu) / sigma, nu) - log(sigma), mean=lambda mu, sigma, nu: mu, start=lambda s: loc(s, nu=1.8))
_f("GT", "Continuous", "mu:identity sigma:log nu:log tau:log", lambda y, mu, sigma, nu, tau: log(tau) - math.log(2) - log(sigma) - log(nu) / tau - betaln(1 / tau, nu) - (nu + 1 / tau) * log1p(absolute((y - mu) / sigma) ** tau / nu), start=lambda s: loc(s, nu=3.0, tau=1.8))
_f("JSU", "Continuous", "mu:identity sigma:log nu:identity tau:log", lambda y, mu, sigma, nu, tau: jsu_((y - mu) / sigma, nu, tau) - log(sigma), cdf=lambda y, mu, sigma, nu, tau: ndtr(nu + tau * asinh((y - mu) / sigma)), quantile=lambda p, mu, sigma, nu, tau: mu + sigma * sinh((ndtri(p) - nu) / tau), start=lambda s: loc(s, nu=0.0, tau=1.0))
register("JSUO", replace(_REGISTRY["JSU"], name="JSUO"))


def _shash(y, mu, sigma, nu, tau):
    a = asinh((y - mu) / sigma)
    up, down = exp(tau * a), exp(-nu * a)
    r, c = 0.5 * (up - down), 0.5 * (tau * up + nu * down)
    z = (y - mu) / sigma
    return log(maximum(c, 1e-300)) - log(sigma) - 0.5 * LOG_2PI - 0.5 * log1p(z * z) - 0.5 * r * r


def _shasho(y, mu, sigma, nu, tau):
    z = (y - mu) / sigma
    a = tau * asinh(z) - nu
    r = sinh(a)
    return log(tau) - log(sigma) - 0.5 * LOG_2PI - 0.5 * log1p(z * z) + log(cosh(a)) - 0.5 * r * r


_f("SHASH", "Continuous", "mu:identity sigma:log nu:identity tau:log", _shash, cdf=lambda y, mu, sigma, nu, tau: ndtr(0.5 * (exp(tau * asinh((y - mu) / sigma)) - exp(-nu * asinh((y - mu) / sigma)))), start=lambda s: loc(s, nu=0.5, tau=0.5))
_f("SHASHO", "Continuous", "mu:identity sigma:log nu:identity tau:log", _shasho, cdf=lambda y, mu, sigma, nu, tau: ndtr(sinh(tau * asinh((y - mu) / sigma) - nu)), quantile=lambda p, mu, sigma, nu, tau: mu + sigma * sinh((asinh(ndtri(p)) + nu) / tau), start=lambda s: loc(s, nu=0.0, tau=1.0))
# normalised here, by the Jacobian of the transformation
_f("SHASHO2", "Continuous", "mu:identity sigma:log nu:identity tau:log", lambda y, mu, sigma, nu, tau: _shasho(y, mu, sigma * tau, nu, tau), cdf=lambda y, mu, sigma, nu, tau: ndtr(sinh(tau * asinh((y - mu) / (sigma * tau)) - nu)), start=lambda s: loc(s, nu=0.0, tau=1.0), status="experimental")
_f("SN1", "Continuous", "mu:identity sigma:log nu:identity", lambda y, mu, sigma, nu: math.log(2) + n_(y, mu, sigma) + log_ndtr(nu * (y - mu) / sigma), start=lambda s: loc(s, nu=0.5))


def _sn2(y, mu, sigma, nu):
    z = (y - mu) / sigma
    return 0.5 * math.log(2 / math.pi) + log(nu) - log(sigma) - log1p(nu * nu) - 0.5 * where(z < 0, nu * nu * z * z, z * z / (nu * nu))


_f("SN2", "Continuous", "mu:identity sigma:log nu:log", _sn2, cdf=lambda y, mu, sigma, nu: where(y < mu, 2 * ndtr(nu * (y - mu) / sigma) / (1 + nu * nu), (1 + nu * nu * (2 * ndtr((y - mu) / (sigma * nu)) - 1)) / (1 + nu * nu)), start=lambda s: loc(s, nu=1.0))
_f("EXGAUS", "Continuous", "mu:identity sigma:log nu:log", lambda y, mu, sigma, nu: where(nu <= 0.05 * sigma, n_(y, mu, sigma), -log(nu) - (y - mu) / nu + sigma * sigma / (2 * nu * nu) + log_ndtr((y - mu) / sigma - sigma / nu)), mean=lambda mu, sigma, nu: mu + nu, start=lambda s: {"mu": s["m"] - 0.5 * sd(s), "sigma": 0.8 * sd(s), "nu": 0.6 * sd(s)})


def _net(y, mu, sigma, nu, tau):
    k2 = maximum(tau, nu)
    a = absolute((y - mu) / sigma)
    c1 = (1 - 2 * ndtr(-nu)) * math.sqrt(2 * math.pi)
    c2 = 2 / nu * (exp(-nu * nu / 2) - exp(-nu * k2 + nu * nu / 2))
    c3 = 2 * k2 * exp(-nu * k2 + nu * nu / 2) / maximum(nu * k2 - 1, 1e-6)
    tail = where(a <= nu, -a * a / 2, where(a <= k2, -nu * a + nu * nu / 2, -nu * k2 * log(maximum(a, 1e-300) / k2) - nu * k2 + nu * nu / 2))
    return tail - log(c1 + c2 + c3) - log(sigma)


_f("NET", "Continuous", "mu:identity sigma:log nu:log tau:log", _net, start=lambda s: loc(s, nu=1.5, tau=2.0))
_f("ST5", "Continuous", "mu:identity sigma:log nu:identity tau:log", lambda y, mu, sigma, nu, tau: math.log(2) + t_((y - mu) / sigma, tau) + log_ndtr(nu * (y - mu) / sigma) - log(sigma), start=lambda s: loc(s, nu=0.0, tau=10.0), status="experimental")

# --- continuous, positive -----------------------------------------------------------------------------------------------
_f("EXP", "Continuous", "mu:log", lambda y, mu: -log(mu) - y / mu, "positive", cdf=lambda y, mu: 1 - exp(-y / mu), quantile=lambda p, mu: -mu * log(1 - p), mean=lambda mu: mu, variance=lambda mu: mu * mu, start=lambda s: {"mu": max(s["m"], 1e-9)})
_f("GA", "Continuous", "mu:log sigma:log", ga_, "positive", mean=lambda mu, sigma: mu, variance=lambda mu, sigma: mu * mu * sigma * sigma, start=pos)
_f("IG", "Continuous", "mu:log sigma:log", ig_, "positive", cdf=lambda y, mu, sigma: ndtr((y / mu - 1) / (sigma * sqrt(y))) + exp(2 / (mu * sigma * sigma) + log_ndtr(-(y / mu + 1) / (sigma * sqrt(y)))), mean=lambda mu, sigma: mu, start=lambda s: {"mu": max(s["m"], 1e-6), "sigma": cv(s) / math.sqrt(max(s["m"], 1e-9))})
_f("LOGNO", "Continuous", "mu:identity sigma:log", lambda y, mu, sigma: n_(log(y), mu, sigma) - log(y), "positive", cdf=lambda y, mu, sigma: ndtr((log(y) - mu) / sigma), quantile=lambda p, mu, sigma: exp(mu + sigma * ndtri(p)), mean=lambda mu, sigma: exp(mu + sigma * sigma / 2), start=lambda s: {"mu": s["lm"], "sigma": max(math.sqrt(max(s["lv"], 1e-9)), 1e-4)})
_f("LOGNO2", "Continuous", "mu:log sigma:log", lambda y, mu, sigma: n_(log(y), log(mu), sigma) - log(y), "positive", cdf=lambda y, mu, sigma: ndtr((log(y) - log(mu)) / sigma), quantile=lambda p, mu, sigma: mu * exp(sigma * ndtri(p)), start=lambda s: {"mu": math.exp(s["lm"]), "sigma": max(math.sqrt(max(s["lv"], 1e-9)), 1e-4)})
_f("LNO", "Continuous", "mu:identity sigma:log", lambda y, mu, sigma: n_(log(y), mu, sigma) - log(y), "positive", cdf=lambda y, mu, sigma: ndtr((log(y) - mu) / sigma), quantile=lambda p, mu, sigma: exp(mu + sigma * ndtri(p)), start=lambda s: {"mu": s["lm"], "sigma": max(math.sqrt(max(s["lv"], 1e-9)), 1e-4)})
_f("WEI", "Continuous", "mu:log sigma:log", lambda y, mu, sigma: log(sigma) - sigma * log(mu) + (sigma - 1) * log(y) - exp(sigma * log(y / mu)), "positive", cdf=lambda y, mu, sigma: 1 - exp(-exp(sigma * log(y / mu))), quantile=lambda p, mu, sigma: mu * exp(log(-log(1 - p)) / sigma), mean=lambda mu, sigma: mu * exp(lgamma(1 + 1 / sigma)), start=lambda s: {"mu": max(s["m"], 1e-6), "sigma": min(max(1.28 / max(math.sqrt(max(s["lv"], 1e-9)), 1e-3), 0.1), 20.0)})
_f("IGAMMA", "Continuous", "mu:log sigma:log", lambda y, mu, sigma: (1 / (sigma * sigma)) * log(mu) + (1 / (sigma * sigma)) * log(1 / (sigma * sigma) + 1) - lgamma(1 / (sigma * sigma)) - (1 / (sigma * sigma) + 1) * log(y) - mu * (1 / (sigma * sigma) + 1) / y, "positive", start=lambda s: {"mu": math.exp(s["lm"]), "sigma": min(cv(s), 0.9)})
_f("PARETO2", "Continuous", "mu:log sigma:log", lambda y, mu, sigma: -log(sigma) + log(mu) / sigma - (1 / sigma + 1) * log(y + mu), "positive", cdf=lambda y, mu, sigma: 1 - exp((log(mu) - log(y + mu)) / sigma), quantile=lambda p, mu, sigma: mu * (exp(-sigma * log(1 - p)) - 1), start=lambda s: {"mu": max(s["m"], 1e-6), "sigma": 0.6})
_f("PARETO", "Continuous", "mu:log", lambda y, mu: log(mu) - (mu + 1) * log(y), "above1", cdf=lambda y, mu: 1 - exp(-mu * log(y)), quantile=lambda p, mu: exp(-log(1 - p) / mu), start=lambda s: {"mu": 1 / max(s["lm"], 1e-3)})


def _gg(y, mu, sigma, nu):
    near = absolute(nu) < 1e-6
    v = where(near, 1.0, nu)
    a = 1 / (sigma * sigma * v * v)
    lz = v * log(y / mu)
    return where(near, n_(log(y), log(mu), sigma) - log(y), a * log(a) - lgamma(a) + a * (lz - exp(lz)) + log(absolute(v)) - log(y))


_f("GG", "Continuous", "mu:log sigma:log nu:log", _gg, "positive", start=lambda s: pos(s, nu=1.0))
_f("GB2", "Continuous", "mu:log sigma:log nu:log tau:log", lambda y, mu, sigma, nu, tau: log(sigma) + (sigma * nu) * log(y / mu) - log(y) - betaln(nu, tau) - (nu + tau) * log_sum(wrap(0.0), sigma * log(y / mu)), "positive", start=lambda s: {"mu": max(s["m"], 1e-6), "sigma": 2.0, "nu": 1.0, "tau": 1.0})


def _bc(log_f, shape):
    def make(y, mu, sigma, nu, **tau):
        z, jac = box_cox(y, mu, sigma, nu)
        return log_f(z, **tau) + jac

    return make


def _bcx(log_f):
    """Box-Cox of y itself: mu and sigma on the transformed scale."""
    def make(y, mu, sigma, nu, tau):
        near = absolute(nu) < 1e-6
        v = where(near, 1.0, nu)
        t = where(near, log(y), (exp(v * log(y)) - 1) / v)
        return log_f((t - mu) / sigma, tau) - log(sigma) + (nu - 1) * log(y)

    return make


def _bcg(z):
    return -0.5 * LOG_2PI - 0.5 * z * z


bc_start = lambda s, **k: {"mu": max(s["m"], 1e-6), "sigma": cv(s), "nu": 1.0, **k}
_f("BCCG", "Continuous", "mu:log sigma:log nu:identity", _bc(_bcg, 0), "positive", cdf=lambda y, mu, sigma, nu: ndtr(box_cox(y, mu, sigma, nu)[0]), quantile=lambda p, mu, sigma, nu: mu * where(absolute(nu) < 1e-6, exp(sigma * ndtri(p)), exp(log(maximum(1 + where(absolute(nu) < 1e-6, 1.0, nu) * sigma * ndtri(p), 1e-12)) / where(absolute(nu) < 1e-6, 1.0, nu))), start=bc_start)
_f("BCT", "Continuous", "mu:log sigma:log nu:identity tau:logshift2", _bc(lambda z, tau: t_(z, tau), 1), "positive", start=lambda s: bc_start(s, tau=10.0))
_f("BCPE", "Continuous", "mu:log sigma:log nu:identity tau:log", _bc(lambda z, tau: pe_(z, tau), 1), "positive", start=lambda s: bc_start(s, tau=2.0))
_f("BCTO", "Continuous", "mu:identity sigma:log nu:identity tau:log", _bcx(t_), "positive", start=lambda s: {"mu": s["lm"], "sigma": max(math.sqrt(s["lv"]), 1e-3), "nu": 0.0, "tau": 10.0}, status="experimental")
_f("BCPEO", "Continuous", "mu:identity sigma:log nu:identity tau:log", _bcx(pe_), "positive", start=lambda s: {"mu": s["lm"], "sigma": max(math.sqrt(s["lv"]), 1e-3), "nu": 0.0, "tau": 2.0}, status="experimental")

# --- continuous in (0, 1), and mixed ------------------------------------------------------------------------------------
be_start = lambda s, **k: {"mu": unit(s["m"]), "sigma": unit(math.sqrt(s["v"] / max(s["m"] * (1 - s["m"]), 1e-3))), **k}
_f("BE", "Continuous", "mu:logit sigma:logit", be_, "unit", mean=lambda mu, sigma: mu, variance=lambda mu, sigma: sigma * sigma * mu * (1 - mu), start=be_start)
_f("SIMPLEX", "Continuous", "mu:logit sigma:log", lambda y, mu, sigma: -0.5 * (LOG_2PI + 2 * log(sigma) + 3 * (log(y) + log(1 - y))) - (y - mu) * (y - mu) / (2 * sigma * sigma * y * (1 - y) * mu * mu * (1 - mu) * (1 - mu)), "unit", start=lambda s: {"mu": unit(s["m"]), "sigma": 1.0})


def _inflated(low, high, base):
    """Odds low and high against 1 of the values 0 and 1."""
    def make(y, **q):
        total = 1 + (q[low] if low else 0) + (q[high] if high else 0)
        inner = (zero(y) if low else wrap(0) > 1, wrap(1) <= y)
        safe = where(y <= 0, 0.5, where(wrap(1) <= y, 0.5, y))
        out = base(safe, q["mu"], q["sigma"]) - log(total)
        if high:
            out = where(inner[1], log(q[high]) - log(total), out)
        if low:
            out = where(inner[0], log(q[low]) - log(total), out)
        return out

    return make


def _mass(at_one, base):
    def make(y, mu, sigma, nu):
        hit = (wrap(1) <= y) if at_one else zero(y)
        return where(hit, log(nu), log(1 - nu) + base(where(y <= 0, 0.5, where(wrap(1) <= y, 0.5, y)), mu, sigma))

    return make


def odds(p):
    return unit(p) / (1 - unit(p))


_f("BEINF", "Mixed", "mu:logit sigma:logit nu:log tau:log", _inflated("nu", "tau", be_), "unit", start=lambda s: be_start(s, nu=odds(s["p0"]), tau=odds(s["p1"])))
_f("BEINF0", "Mixed", "mu:logit sigma:logit nu:log", _inflated("nu", None, be_), "unit", start=lambda s: be_start(s, nu=odds(s["p0"])))
_f("BEINF1", "Mixed", "mu:logit sigma:logit nu:log", _inflated(None, "nu", be_), "unit", start=lambda s: be_start(s, nu=odds(s["p1"])))
_mp = lambda y, mu, sigma: beta_(y, mu * sigma, (1 - mu) * sigma)
_f("BEZI", "Mixed", "mu:logit sigma:log nu:logit", _mass(False, _mp), "unit", start=lambda s: {"mu": unit(s["m"]), "sigma": 2.0, "nu": unit(s["p0"])})
_f("BEOI", "Mixed", "mu:logit sigma:log nu:logit", _mass(True, _mp), "unit", start=lambda s: {"mu": unit(s["m"]), "sigma": 2.0, "nu": unit(s["p1"])})
_f("ZAGA", "Mixed", "mu:log sigma:log nu:logit", zero_altered(ga_, None, "nu"), "positive", start=lambda s: pos(s, nu=unit(s["p0"])))
_f("ZAIG", "Mixed", "mu:log sigma:log nu:logit", zero_altered(ig_, None, "nu"), "positive", start=lambda s: {"mu": max(s["m"], 1e-6), "sigma": cv(s) / math.sqrt(max(s["m"], 1e-9)), "nu": unit(s["p0"])})

# --- counts -------------------------------------------------------------------------------------------------------------
mu_start = lambda s: {"mu": max(s["m"], 0.01)}
_f("PO", "Discrete", "mu:log", po_, "count", mean=lambda mu: mu, variance=lambda mu: mu, start=mu_start)


def _bi(y, mu, bd):
    k = where(y <= 1, floor(y * bd + 0.5), y)
    return lgamma(bd + 1) - lgamma(k + 1) - lgamma(bd - k + 1) + k * log(mu) + (bd - k) * log(1 - mu)


_f("BI", "Discrete", "mu:logit", _bi, "count", mean=lambda mu, bd: mu * bd, start=lambda s: {"mu": unit(s["m"] if s["m"] <= 1 else s["m"] / max(s.get("bd", s["max"]), 1))}, fixed={"bd": 1.0})
_f("GEOM", "Discrete", "mu:log", lambda y, mu: y * log(mu) - (y + 1) * log1p(mu), "count", cdf=lambda y, mu: 1 - exp((floor(y) + 1) * (log(mu) - log1p(mu))), mean=lambda mu: mu, start=mu_start)
_f("NBI", "Discrete", "mu:log sigma:log", nbi_, "count", mean=lambda mu, sigma: mu, variance=lambda mu, sigma: mu + sigma * mu * mu, start=lambda s: {"mu": max(s["m"], 0.01), "sigma": over(s)})
_f("NBII", "Discrete", "mu:log sigma:log", lambda y, mu, sigma: nb_(y, mu, mu / sigma), "count", mean=lambda mu, sigma: mu, start=lambda s: {"mu": max(s["m"], 0.01), "sigma": max(s["v"] / max(s["m"], 1e-6) - 1, 0.05)})
zi_start = lambda s, p="sigma", **k: {"mu": max(s["m"] / max(1 - s["p0"], 0.05), 0.05), p: unit(0.7 * s["p0"]), **k}
_f("ZIP", "Discrete", "mu:log sigma:logit", zero_inflated_(po_, "sigma"), "count", mean=lambda mu, sigma: (1 - sigma) * mu, start=zi_start)
_f("ZIP2", "Discrete", "mu:log sigma:logit", lambda y, mu, sigma: zero_inflated_(po_, "sigma")(y, mu=mu / (1 - sigma), sigma=sigma), "count", mean=lambda mu, sigma: mu, start=lambda s: {"mu": max(s["m"], 0.05), "sigma": unit(0.7 * s["p0"])})
_f("ZAP", "Discrete", "mu:log sigma:logit", zero_altered(po_, lambda mu: -mu, "sigma"), "count", start=lambda s: {"mu": max(s["m"] / max(1 - s["p0"], 0.05), 0.05), "sigma": unit(s["p0"])})
_f("ZINBI", "Discrete", "mu:log sigma:log nu:logit", zero_inflated_(nbi_, "nu"), "count", start=lambda s: zi_start(s, "nu", sigma=0.5))
_f("ZANBI", "Discrete", "mu:log sigma:log nu:logit", zero_altered(nbi_, lambda mu, sigma: nbi_(wrap(0.0), mu, sigma), "nu"), "count", start=lambda s: {"mu": max(s["m"], 0.05), "sigma": 0.5, "nu": unit(s["p0"])})
_f("ZIBI", "Discrete", "mu:logit nu:logit", lambda y, mu, nu, bd: zero_inflated_(_bi, "nu")(y, mu=mu, nu=nu, bd=bd), "count", start=lambda s: {"mu": unit(s["m"]), "nu": 0.1}, fixed={"bd": 1.0})
_f("ZABI", "Discrete", "mu:logit nu:logit", zero_altered(_bi, lambda mu, bd: bd * log(1 - mu), "nu"), "count", start=lambda s: {"mu": unit(s["m"]), "nu": unit(s["p0"])}, fixed={"bd": 1.0})


def _bb(y, mu, sigma, bd):
    a, b = mu / sigma, (1 - mu) / sigma
    return lgamma(bd + 1) - lgamma(y + 1) - lgamma(bd - y + 1) + betaln(y + a, bd - y + b) - betaln(a, b)


_f("BB", "Discrete", "mu:logit sigma:log", _bb, "count", mean=lambda mu, sigma, bd: bd * mu, start=lambda s: {"mu": unit(s["m"] / max(s.get("bd", s["max"]), 1)), "sigma": 0.2}, fixed={"bd": 1.0})
_f("ZIBB", "Discrete", "mu:logit sigma:log nu:logit", lambda y, mu, sigma, nu, bd: zero_inflated_(_bb, "nu")(y, mu=mu, sigma=sigma, nu=nu, bd=bd), "count", start=lambda s: {"mu": unit(s["m"] / max(s["max"], 1)), "sigma": 0.2, "nu": 0.1}, fixed={"bd": 1.0})
_f("ZABB", "Discrete", "mu:logit sigma:log nu:logit", zero_altered(_bb, lambda mu, sigma, bd: _bb(wrap(0.0), mu, sigma, bd), "nu"), "count", start=lambda s: {"mu": unit(s["m"] / max(s["max"], 1)), "sigma": 0.2, "nu": unit(s["p0"])}, fixed={"bd": 1.0})


def _bnb(y, mu, sigma, nu):
    m, n, k = 1 / sigma + 1, mu * nu / sigma, 1 / nu
    return betaln(y + n, m + k) - betaln(n, m) - lgamma(y + 1) - lgamma(k) + lgamma(y + k)


_f("BNB", "Discrete", "mu:log sigma:log nu:log", _bnb, "count", start=lambda s: {"mu": max(s["m"], 0.05), "sigma": 0.5, "nu": 1.0})
_f("ZIBNB", "Discrete", "mu:log sigma:log nu:log tau:logit", zero_inflated_(_bnb, "tau"), "count", start=lambda s: zi_start(s, "tau", sigma=0.5, nu=1.0))
_f("ZABNB", "Discrete", "mu:log sigma:log nu:log tau:logit", zero_altered(_bnb, lambda **q: _bnb(wrap(0.0), **q), "tau"), "count", start=lambda s: {"mu": max(s["m"], 0.05), "sigma": 0.5, "nu": 1.0, "tau": unit(s["p0"])})
_f("YULE", "Discrete", "mu:log", lambda y, mu: betaln((mu + 1) / mu + 1, y + 1) - betaln((mu + 1) / mu, 1), "count", mean=lambda mu: mu, start=mu_start)
_f("WARING", "Discrete", "mu:log sigma:log", lambda y, mu, sigma: betaln(y + mu / sigma, 1 / sigma + 2) - betaln(mu / sigma, 1 / sigma + 1), "count", mean=lambda mu, sigma: mu, start=lambda s: {"mu": max(s["m"], 0.01), "sigma": 0.5})


def _log1mexp_p(mu):
    return log(-log(1 - mu))


_f("LG", "Discrete", "mu:logit", lambda y, mu: y * log(mu) - log(y) - _log1mexp_p(mu), "count1", start=lambda s: {"mu": 0.6})
_f("ZALG", "Discrete", "mu:logit sigma:logit", zero_altered(lambda y, mu: y * log(mu) - log(y) - _log1mexp_p(mu), None, "sigma"), "count", start=lambda s: {"mu": 0.6, "sigma": unit(s["p0"])})


def _categories(n):
    """Odds against the last class; the others are 1 to n - 1."""
    def make(y, **q):
        total = 1.0
        for p in q.values():
            total = total + p
        out = -log(total)
        for k, p in reversed(list(enumerate(q.values(), 1))):
            out = where(floor(y + 0.5).eq(k), log(p) - log(total), out)
        return out

    return make


for _n in (3, 4, 5):
    _f(f"MN{_n}", "Discrete", " ".join(f"{p}:log" for p in PARAMETERS[: _n - 1]), _categories(_n), "count", start=lambda s, n=_n: {p: 1.0 for p in PARAMETERS[: n - 1]})

# --- further names of the same kinds ------------------------------------------------------------------------------------
_f("BEO", "Continuous", "mu:log sigma:log", lambda y, mu, sigma: beta_(y, mu, sigma), "unit", start=lambda s: {"mu": 1.0, "sigma": 1.0})
_f("GEOMO", "Discrete", "mu:logit", lambda y, mu: log(mu) + y * log(1 - mu), "count", start=lambda s: {"mu": unit(1 / (1 + s["m"]))})
_f("WEI2", "Continuous", "mu:log sigma:log", lambda y, mu, sigma: log(sigma) + log(mu) + (sigma - 1) * log(y) - mu * exp(sigma * log(y)), "positive", start=lambda s: {"mu": 1 / max(s["m"], 1e-6), "sigma": 1.0})
_f("WEI3", "Continuous", "mu:log sigma:log", lambda y, mu, sigma: (lambda b: log(sigma) - sigma * log(b) + (sigma - 1) * log(y) - exp(sigma * log(y / b)))(mu / exp(lgamma(1 / sigma + 1))), "positive", mean=lambda mu, sigma: mu, start=lambda s: {"mu": max(s["m"], 1e-6), "sigma": 1.0})
_f("PARETO2O", "Continuous", "mu:log sigma:log", lambda y, mu, sigma: log(sigma) + sigma * log(mu) - (sigma + 1) * log(y + mu), "positive", cdf=lambda y, mu, sigma: 1 - exp(sigma * (log(mu) - log(y + mu))), start=lambda s: {"mu": max(s["m"], 1e-6), "sigma": 2.0})
_f("NOF", "Continuous", "mu:identity sigma:log nu:identity", lambda y, mu, sigma, nu: n_(y, mu, sigma * exp(0.5 * nu * log(maximum(absolute(mu), 1e-9)))), start=lambda s: loc(s, nu=0.0), status="experimental")
_f("GAF", "Continuous", "mu:log sigma:log nu:identity", lambda y, mu, sigma, nu: ga_(y, mu, sigma * exp((nu / 2 - 1) * log(mu))), "positive", start=lambda s: {"mu": max(s["m"], 1e-6), "sigma": cv(s), "nu": 2.0}, status="experimental")
_f("IGA", "Continuous", "mu:log sigma:log", lambda y, mu, sigma: mu * log(sigma) - lgamma(mu) - (mu + 1) * log(y) - sigma / y, "positive", start=lambda s: {"mu": 3.0, "sigma": 2 * max(s["m"], 1e-6)})
_f("LOGITNO", "Continuous", "mu:identity sigma:log", lambda y, mu, sigma: n_(log(y / (1 - y)), mu, sigma) - log(y) - log(1 - y), "unit", cdf=lambda y, mu, sigma: ndtr((log(y / (1 - y)) - mu) / sigma), quantile=lambda p, mu, sigma: 1 / (1 + exp(-(mu + sigma * ndtri(p)))), start=lambda s: {"mu": math.log(odds(s["m"])), "sigma": 1.0})
_f("PE2", "Continuous", "mu:identity sigma:log nu:log", lambda y, mu, sigma, nu: log(nu) - log(2 * sigma) - lgamma(1 / nu) - absolute((y - mu) / sigma) ** nu, start=lambda s: loc(s, nu=1.8))
_f("GPO", "Discrete", "mu:log sigma:log", lambda y, mu, sigma: y * log(mu / (1 + sigma * mu)) + (y - 1) * log1p(sigma * y) - mu * (1 + sigma * y) / (1 + sigma * mu) - lgamma(y + 1), "count", start=lambda s: {"mu": max(s["m"], 0.05), "sigma": 0.1})
_f("EGB2", "Continuous", "mu:identity sigma:log nu:log tau:log", lambda y, mu, sigma, nu, tau: nu * (y - mu) / sigma - log(sigma) - betaln(nu, tau) - (nu + tau) * log_sum(wrap(0.0), (y - mu) / sigma), start=lambda s: loc(s, nu=1.0, tau=1.0))
_f("GB1", "Continuous", "mu:logit sigma:logit nu:log tau:log", lambda y, mu, sigma, nu, tau: (lambda a, b, t: log(tau) + b * log(nu) + (tau * a - 1) * log(y) + (b - 1) * log(1 - t) - betaln(a, b) - (a + b) * log(nu + (1 - nu) * t))(mu * (1 / (sigma * sigma) - 1), (1 - mu) * (1 / (sigma * sigma) - 1), exp(tau * log(y))), "unit", start=lambda s: be_start(s, nu=1.0, tau=1.0))
_f("NBF", "Discrete", "mu:log sigma:log nu:log", lambda y, mu, sigma, nu: nb_(y, mu, 1 / (sigma * exp((nu - 2) * log(mu)))), "count", start=lambda s: {"mu": max(s["m"], 0.05), "sigma": over(s), "nu": 2.0})
_f("ZINBF", "Discrete", "mu:log sigma:log nu:log tau:logit", zero_inflated_(lambda y, mu, sigma, nu: nb_(y, mu, 1 / (sigma * exp((nu - 2) * log(mu)))), "tau"), "count", start=lambda s: zi_start(s, "tau", sigma=0.5, nu=2.0))
_f("LOGSHASH", "Continuous", "mu:identity sigma:log nu:identity tau:log", lambda y, mu, sigma, nu, tau: _shash(log(y), mu, sigma, nu, tau) - log(y), "positive", start=lambda s: {"mu": s["lm"], "sigma": max(math.sqrt(s["lv"]), 1e-3), "nu": 0.5, "tau": 0.5})
_f("PARETO1", "Continuous", "mu:log", lambda y, mu: log(mu) - (mu + 1) * log1p(y), "positive", cdf=lambda y, mu: 1 - exp(-mu * log1p(y)), start=lambda s: {"mu": 1.0})
_f("SST", "Continuous", "mu:identity sigma:log nu:log tau:logshift2", lambda y, mu, sigma, nu, tau: math.log(2) + log(nu) - log1p(nu * nu) - log(sigma) + t_(where(y < mu, nu, 1 / nu) * (y - mu) / sigma, tau), start=lambda s: loc(s, nu=1.0, tau=10.0))
_f("ST3C", "Continuous", "mu:identity sigma:log nu:log tau:log", lambda y, mu, sigma, nu, tau: math.log(2) + log(nu) - log1p(nu * nu) - log(sigma) + t_(where(y < mu, nu, 1 / nu) * (y - mu) / sigma, tau), start=lambda s: loc(s, nu=1.0, tau=10.0))
_f("SEP3", "Continuous", "mu:identity sigma:log nu:log tau:log", lambda y, mu, sigma, nu, tau: log(nu) - log(sigma) - log1p(nu * nu) - (1 / tau) * math.log(2) - lgamma(1 + 1 / tau) - 0.5 * (where(y < mu, nu, 1 / nu) * absolute((y - mu) / sigma)) ** tau, start=lambda s: loc(s, nu=1.0, tau=2.0))


# --- mixed Poisson families, by quadrature and recursion in numpy -------------------------------------------------------


def log_bessel_k(order, z):
    """log K_order(z) by the trapezoidal rule on its integral over exp(-z cosh t) cosh(order t)."""
    order, z = np.broadcast_arrays(np.abs(np.asarray(order, float)), np.asarray(z, float))
    peak = np.arcsinh(order / z)
    width = 12.0 / np.sqrt(np.sqrt(order * order + z * z)) + 0.5
    t = np.maximum(peak, 0)[..., None] + width[..., None] * np.linspace(-1, 1, 241)
    f = -z[..., None] * np.cosh(t) + order[..., None] * t
    top = f.max(axis=-1)
    # the integral over the whole line of exp(order t - z cosh t) is 2 K
    return top + np.log(np.exp(f - top[..., None]).sum(axis=-1) * (width * 2 / 240)) - math.log(2)


def _np_lgamma(x):
    return special_lgamma(Numpy, np.asarray(x, float))


def _sichel(y, mu, sigma, nu, scaled=True):
    c = np.exp(log_bessel_k(nu + 1, 1 / sigma) - log_bessel_k(nu, 1 / sigma)) if scaled else 1.0
    alpha = np.sqrt(1 / sigma**2 + 2 * mu / (c * sigma))
    return y * np.log(mu / c) - (y + nu) * np.log(alpha * sigma) + log_bessel_k(y + nu, alpha) - log_bessel_k(nu, 1 / sigma) - _np_lgamma(y + 1)


def _delaporte(y, mu, sigma, nu):
    """Sum over the Poisson part of a Poisson plus a negative binomial."""
    y, mu, sigma, nu = np.broadcast_arrays(*(np.asarray(x, float) for x in (y, mu, sigma, nu)))
    out = np.full(y.shape, -np.inf)
    size, m = 1 / sigma, mu * (1 - nu)
    for j in range(int(y.max(initial=0)) + 1):
        k = np.maximum(y - j, 0)
        p = j * np.log(mu * nu) - mu * nu - math.lgamma(j + 1) + _np_lgamma(k + size) - _np_lgamma(size) - _np_lgamma(k + 1) + size * np.log(size / (size + m)) + k * np.log(m / (size + m))
        out = np.where(j <= y, np.logaddexp(out, p), out)
    return out


def _double_poisson(y, mu, sigma):
    def raw(k):
        lk = np.where(k > 0, np.log(np.maximum(k, 1)), 0.0)
        return -0.5 * np.log(sigma) - mu / sigma - _np_lgamma(k + 1) + k * lk - k + k * (1 + np.log(mu) - lk) / sigma

    y, mu, sigma = np.broadcast_arrays(*(np.asarray(x, float) for x in (y, mu, sigma)))
    total = np.full(y.shape, -np.inf)
    for k in range(int(max(y.max(initial=0) * 3, (mu + 12 * np.sqrt(mu * np.maximum(sigma, 1))).max(initial=0), 60)) + 1):
        total = np.logaddexp(total, raw(np.full(y.shape, float(k))))
    return raw(y) - total


def _numeric(name, links, logpdf, start, **more):
    register(name, Family(name, "Discrete", dict(x.split(":") for x in links.split()), None, "count", np_logpdf=logpdf, start=start, **more))


_numeric("PIG", "mu:log sigma:log", lambda y, mu, sigma: _sichel(y, mu, sigma, np.float64(-0.5), scaled=False), lambda s: {"mu": max(s["m"], 0.05), "sigma": over(s)})
_numeric("SICHEL", "mu:log sigma:log nu:identity", _sichel, lambda s: {"mu": max(s["m"], 0.05), "sigma": over(s), "nu": -0.5})
_numeric("SI", "mu:log sigma:log nu:identity", lambda y, mu, sigma, nu: _sichel(y, mu, sigma, nu, scaled=False), lambda s: {"mu": max(s["m"], 0.05), "sigma": over(s), "nu": -0.5})
_numeric("DEL", "mu:log sigma:log nu:logit", _delaporte, lambda s: {"mu": max(s["m"], 0.05), "sigma": over(s), "nu": 0.4})
_numeric("DPO", "mu:log sigma:log", _double_poisson, lambda s: {"mu": max(s["m"], 0.05), "sigma": max(s["v"] / max(s["m"], 1e-6), 0.2)})


# --- extensions: normalised here where the usual short forms are not ----------------------------------------------------


def _sep1(y, mu, sigma, nu, tau):
    skew = where(y < mu, exp(nu), exp(-nu))
    return log(tau) - log(sigma) - log_sum(nu, -nu) - lgamma(1 / tau) - (absolute((y - mu) / sigma) * skew) ** tau


def _sep(y, mu, sigma, nu, tau):
    return -log(sigma) - log(nu + 1 / nu) - lgamma(1 + 1 / tau) - (absolute((y - mu) / sigma) * where(y < mu, nu, 1 / nu)) ** tau


for _name in ("SEP1", "SEP2", "SEP4"):
    _f(_name, "Continuous", "mu:identity sigma:log nu:identity tau:log", _sep1, start=lambda s: loc(s, nu=0.0, tau=1.8), status="experimental")
_f("SEP", "Continuous", "mu:identity sigma:log nu:log tau:log", _sep, start=lambda s: loc(s, nu=1.0, tau=1.8), status="experimental")
_f("RGE", "Continuous", "mu:identity sigma:log nu:log", lambda y, mu, sigma, nu: nu * log(nu) - lgamma(nu) - log(sigma) - nu * (y - mu) / sigma - nu * exp(-(y - mu) / sigma), start=lambda s: loc(s, nu=1.0), status="experimental")


def _lqno(y, mu, sigma, nu):
    """The log response's tanh(nu z) is a standard normal cut at -1 and 1."""
    q = tanh(nu * (log(y) - mu) / sigma)
    return log(nu) + log(maximum(1 - q * q, 1e-300)) - 0.5 * q * q - log(sigma) - log(y) - 0.5 * LOG_2PI - math.log(math.erf(1 / math.sqrt(2)))


_f("LQNO", "Continuous", "mu:log sigma:log nu:log", _lqno, "positive", start=lambda s: {"mu": max(s["lm"], 1e-3), "sigma": max(math.sqrt(max(s["lv"], 1e-9)), 1e-3), "nu": 0.7}, status="experimental")
_f("PARETO1O", "Continuous", "mu:log sigma:log", lambda y, mu, sigma: where(mu < y, log(sigma) + sigma * log(mu) - (sigma + 1) * log(y), wrap(-math.inf)), "positive", cdf=lambda y, mu, sigma: where(mu < y, 1 - exp(sigma * log(mu / y)), wrap(0.0)), quantile=lambda p, mu, sigma: mu * exp(-log(1 - p) / sigma), start=lambda s: {"mu": 0.5 * math.exp(s["lm"]), "sigma": 1.0})
_f("LOGSHASHO", "Continuous", "mu:identity sigma:log nu:identity tau:log", lambda y, mu, sigma, nu, tau: _shasho(log(y), mu, sigma, nu, tau) - log(y), "positive", cdf=lambda y, mu, sigma, nu, tau: ndtr(sinh(tau * asinh((log(y) - mu) / sigma) - nu)), start=lambda s: {"mu": s["lm"], "sigma": max(math.sqrt(s["lv"]), 1e-3), "nu": 0.0, "tau": 1.0})


def _cut(sigma, nu):
    """log of the normal's probability of a positive response under a Box-Cox transformation."""
    return log_ndtr(1 / (sigma * maximum(absolute(nu), 1e-9)))


_f("BCCGO", "Continuous", "mu:log sigma:log nu:identity", lambda y, mu, sigma, nu: _bc(_bcg, 0)(y, mu, sigma, nu) - _cut(sigma, nu), "positive", start=bc_start)


def _dpo1(y, mu, sigma):
    """Double Poisson with Efron's approximate constant."""
    safe = where(zero(y), 1.0, y)
    ly = where(zero(y), wrap(0.0), log(safe))
    return -0.5 * log(sigma) - mu / sigma - y + y * ly - lgamma(y + 1) + y * (1 + log(mu) - ly) / sigma - log(1 + (sigma - 1) / (12 * mu) * (1 + sigma / mu))


_f("DPO1", "Discrete", "mu:log sigma:log", _dpo1, "count", start=lambda s: {"mu": max(s["m"], 0.05), "sigma": max(s["v"] / max(s["m"], 1e-6), 0.2)}, status="experimental")


def log_zeta(s, terms: int = 12):
    """log of Riemann's zeta function at s > 1 by Euler and Maclaurin."""
    n = float(terms)
    total = 1 + n * exp(-s * math.log(n)) / (s - 1) + 0.5 * exp(-s * math.log(n))
    for k in range(2, terms):
        total = total + exp(-s * math.log(k))
    total = total + exp(-s * math.log(n)) * (s / (12 * n) - s * (s + 1) * (s + 2) / (720 * n**3) + s * (s + 1) * (s + 2) * (s + 3) * (s + 4) / (30240 * n**5))
    return log(total)


def _zipf(y, mu):
    return -(mu + 1) * log(y) - log_zeta(mu + 1)


_f("ZIPF", "Discrete", "mu:log", _zipf, "count1", start=lambda s: {"mu": 1 / max(s["lm"], 0.2)})
_f("ZAZIPF", "Discrete", "mu:log sigma:logit", zero_altered(_zipf, None, "sigma"), "count", start=lambda s: {"mu": 1 / max(s["lm"], 0.2), "sigma": unit(s["p0"])})
_f("GENERALISEDPOISSON", "Discrete", "mu:log sigma:logit", lambda y, mu, sigma: log(mu * (1 - sigma)) + (y - 1) * log(mu * (1 - sigma) + sigma * y) - mu * (1 - sigma) - sigma * y - lgamma(y + 1), "count", mean=lambda mu, sigma: mu, start=lambda s: {"mu": max(s["m"], 0.05), "sigma": unit(1 - math.sqrt(max(s["m"], 1e-6) / max(s["v"], 1e-6))) if s["v"] > s["m"] else 0.05})
_numeric("PIG2", "mu:log sigma:log", lambda y, mu, sigma: _sichel(y, mu, sigma / mu, np.float64(-0.5), scaled=False), lambda s: {"mu": max(s["m"], 0.05), "sigma": max(s["v"] / max(s["m"], 1e-6) - 1, 0.05)})
_numeric("DELAPORT", "mu:log sigma:log nu:log", lambda y, mu, sigma, nu: _delaporte(y, mu, sigma**2, 1 / (1 + sigma * nu)), lambda s: {"mu": max(s["m"], 0.05), "sigma": math.sqrt(over(s)), "nu": 1.0})


def _gig(y, mu, sigma, nu):
    chi, psi = 1 / sigma**2, 1 / (mu * sigma) ** 2
    return (nu - 1) * np.log(y) - 0.5 * (chi / y + psi * y) - log_bessel_k(nu, np.sqrt(chi * psi)) - 0.5 * nu * np.log(chi / psi) - math.log(2)


register("GIG", Family("GIG", "Continuous", {"mu": "log", "sigma": "log", "nu": "identity"}, None, "positive", np_logpdf=_gig, start=lambda s: {"mu": max(s["m"], 1e-6), "sigma": cv(s) / math.sqrt(max(s["m"], 1e-9)), "nu": -0.5}))


def _np_zero(log_f, p, altered):
    """A numeric log density with a mass at 0: altered, or inflated."""
    def make(y, **q):
        rest = {k: v for k, v in q.items() if k != p}
        at_zero = log_f(np.zeros(np.shape(y)), **rest)
        with np.errstate(all="ignore"):
            if altered:
                return np.where(y <= 0, np.log(q[p]), np.log(1 - q[p]) + log_f(np.maximum(y, 1), **rest) - np.log1p(-np.exp(at_zero)))
            return np.where(y <= 0, np.logaddexp(np.log(q[p]), np.log(1 - q[p]) + at_zero), np.log(1 - q[p]) + log_f(y, **rest))

    return make


for _name, _p in (("PIG", "nu"), ("SICHEL", "tau")):
    for _kind in ("ZI", "ZA"):
        _b = _REGISTRY[_name]
        register(f"{_kind}{_name}", replace(_b, name=f"{_kind}{_name}", links=_b.links | {_p: "logit"}, np_logpdf=_np_zero(_b.np_logpdf, _p, _kind == "ZA"), start=lambda s, b=_b, p=_p, k=_kind: b.start(s) | {p: unit(s["p0"] * (1.0 if k == "ZA" else 0.7))}))


# --- builders -----------------------------------------------------------------------------------------------------------


def from_logpdf(name: str, links: dict[str, str], logpdf: Callable[..., E], kind: str = "Continuous", support: str = "real", start=None, **more) -> Family:
    """A user's family from a log density over expressions."""
    return Family(name, kind, dict(links), logpdf, support, start=start or (lambda s: {}), **more)


def zero_inflated(base: str | Family, name: str | None = None) -> Family:
    """pi + (1 - pi) f(0) at 0; adds the parameter pi."""
    b = resolve(base)
    made = {"logpdf": zero_inflated_(b.logpdf, "pi")} if b.logpdf else {"np_logpdf": _np_zero(b.np_logpdf, "pi", False)}
    return replace(b, name=name or f"ZI{b.name}", kind="Mixed" if b.kind == "Continuous" else "Discrete", links=b.links | {"pi": "logit"}, **made, cdf=None, quantile=None, mean=None, variance=None, start=lambda s: b.start(s) | {"pi": unit(0.7 * s["p0"])})


def hurdle(base: str | Family, name: str | None = None) -> Family:
    """Mass pi at 0; the base, cut at 0 if it is discrete, for the positive values."""
    b = resolve(base)
    at_zero = (lambda **q: b.logpdf(wrap(0.0), **q)) if b.kind == "Discrete" else None
    made = {"logpdf": zero_altered(b.logpdf, at_zero, "pi")} if b.logpdf else {"np_logpdf": _np_zero(b.np_logpdf, "pi", True)}
    return replace(b, name=name or f"HU{b.name}", kind="Mixed" if b.kind == "Continuous" else "Discrete", links=b.links | {"pi": "logit"}, **made, cdf=None, quantile=None, mean=None, variance=None, start=lambda s: b.start(s) | {"pi": unit(s["p0"])})


def finite_mixture(components: list[str | Family], name: str | None = None) -> Family:
    """K components with parameters <p>_<k> and weights by stick breaking: pi_k of what the components before left."""
    parts = [resolve(c) for c in components]

    def logpdf(y, **q):
        left, terms = wrap(0.0), []
        for k, b in enumerate(parts, 1):
            own = b.logpdf(y, **{p: q[f"{p}_{k}"] for p in b.links})
            terms.append(left + own + (log(q[f"pi_{k}"]) if k < len(parts) else 0.0))
            left = left + log(1 - q[f"pi_{k}"]) if k < len(parts) else left
        out = terms[0]
        for t in terms[1:]:
            out = log_sum(out, t)
        return out

    links = {f"{p}_{k}": x for k, b in enumerate(parts, 1) for p, x in b.links.items()} | {f"pi_{k}": "logit" for k in range(1, len(parts))}

    def start(s):
        out = {f"pi_{k}": 1 / (len(parts) - k + 1) for k in range(1, len(parts))}
        for k, b in enumerate(parts, 1):
            shift = (k - (len(parts) + 1) / 2) * sd(s)
            out |= {f"{p}_{k}": (v + shift if b.links[p] == "identity" else v * math.exp(shift / max(abs(s["m"]), sd(s), 1e-9))) if p == "mu" else v for p, v in b.start(s).items()}
        return out

    return Family(name or "MX", parts[0].kind, links, logpdf, parts[0].support, start=start)


def censored(base: str | Family, name: str | None = None) -> Family:
    """Right-censored: a fixed column `event` is 1 where y was observed and 0 where it is a lower bound. Needs a closed CDF."""
    b = resolve(base)
    if b.cdf is None:
        raise ValueError(f"{b.name} has no closed CDF")

    def logpdf(y, event, **q):
        return where(event > 0.5, b.logpdf(y, **q), log(maximum(1 - b.cdf(y, **q), 1e-300)))

    return replace(b, name=name or f"{b.name}rc", logpdf=logpdf, fixed=b.fixed | {"event": 1.0})


__all__ = ["Family", "censored", "clip", "finite_mixture", "from_logpdf", "hurdle", "list_families", "log_bessel_k", "minimum", "register", "resolve", "tanh", "zero_inflated"]
