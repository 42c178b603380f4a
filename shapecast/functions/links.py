"""Link functions as expressions: link, inverse, and derivative of the inverse with respect to the predictor."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from .expr import E, absolute, clip, diff, exp, log, log1p, maximum, ndtr, ndtri, sqrt, var, wrap

#: Predictors of log-type and logit-type links are kept in this range; identity and the others are not.
ETA_MAX = 30.0


@dataclass(frozen=True)
class Link:
    name: str
    link: Callable[[E], E]
    inverse: Callable[[E], E]

    def derivative(self, eta: E) -> E:
        """d mu / d eta"""
        x = var("__eta")
        return _substitute(diff(self.inverse(x), "__eta"), "__eta", eta)


def _substitute(e: E, name: str, by: E) -> E:
    if e.op == "var":
        return by if e.val == name else e
    return e if not e.args else E(e.op, *[_substitute(x, name, by) for x in e.args], val=e.val)


def _bounded(eta: E) -> E:
    return clip(eta, -ETA_MAX, ETA_MAX)


LINKS = {
    x.name: x
    for x in (
        Link("identity", wrap, wrap),
        Link("log", log, lambda e: exp(_bounded(e))),
        Link("logit", lambda m: log(m / (1 - m)), lambda e: 1 / (1 + exp(-_bounded(e)))),
        Link("probit", ndtri, ndtr),
        Link("cloglog", lambda m: log(-log(1 - m)), lambda e: 1 - exp(-exp(_bounded(e)))),
        Link("inverse", lambda m: 1 / m, lambda e: 1 / e),
        Link("1/mu^2", lambda m: 1 / (m * m), lambda e: 1 / sqrt(e)),
        Link("sqrt", sqrt, lambda e: e * e),
        Link("softplus", lambda m: m + log(1 - exp(-m)), lambda e: maximum(e, 0.0) + log1p(exp(-absolute(e)))),
        Link("logshift2", lambda m: log(m - 2), lambda e: 2 + exp(_bounded(e))),
        Link("logshift1", lambda m: log(m - 1), lambda e: 1 + exp(_bounded(e))),
    )
}
ALIASES = {"logarithmic": "log", "ident": "identity", "reciprocal": "inverse", "1/mu": "inverse", "logshiftto2": "logshift2", "logshiftto1": "logshift1"}


def get_link(name: str) -> Link:
    """Case-insensitive, with aliases; raises ValueError for unknown names."""
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in LINKS:
        raise ValueError(f"unknown link {name!r}; known: {sorted(LINKS)}")
    return LINKS[key]
