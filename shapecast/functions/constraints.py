"""What values responses and parameters may have, as predicates over Columns and numpy, and checks that name a code."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .families import Family, resolve


class ValidationError(ValueError):
    """code: finite, support, parameter, shape or null."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Constraint:
    """An open interval, closed where `closed_low` or `closed_high` says so; whole numbers only if `whole`."""

    name: str
    low: float = -np.inf
    high: float = np.inf
    closed_low: bool = False
    closed_high: bool = False
    whole: bool = False

    def holds(self, x: Column) -> Column:
        """False for null, NaN and infinite values."""
        ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        if np.isfinite(self.low):
            ok = ok & ((x >= self.low) if self.closed_low else (x > self.low))
        if np.isfinite(self.high):
            ok = ok & ((x <= self.high) if self.closed_high else (x < self.high))
        return ok & (x == F.floor(x)) if self.whole else ok

    def check(self, x) -> np.ndarray:
        x = np.asarray(x, float)
        ok = np.isfinite(x) & ((x >= self.low) if self.closed_low else (x > self.low)) & ((x <= self.high) if self.closed_high else (x < self.high))
        return ok & (x == np.floor(x)) if self.whole else ok

    def clip(self, x: Column, margin: float = 1e-9) -> Column:
        low = self.low if self.closed_low else self.low + margin
        high = self.high if self.closed_high else self.high - margin
        x = F.greatest(x, F.lit(low)) if np.isfinite(self.low) else x
        return F.least(x, F.lit(high)) if np.isfinite(self.high) else x


REAL, POSITIVE, UNIT = Constraint("real"), Constraint("positive", 0.0), Constraint("unit", 0.0, 1.0)
#: Constraints of parameters by link.
BY_LINK = {"identity": REAL, "log": POSITIVE, "logit": UNIT, "probit": UNIT, "cloglog": UNIT, "logshift2": Constraint("over2", 2.0), "logshift1": Constraint("over1", 1.0), "sqrt": POSITIVE, "softplus": POSITIVE, "inverse": REAL, "1/mu^2": POSITIVE}


def positive_constraint(name: str) -> Constraint:
    return Constraint(name, 0.0)


def finite_constraint(name: str) -> Constraint:
    return Constraint(name)


def range_constraint(name: str, low: float, high: float) -> Constraint:
    return Constraint(name, low, high, True, True)


@dataclass(frozen=True)
class ParameterSpec:
    """A parameter's name, link and constraint."""

    name: str
    link: str
    constraint: Constraint

    def holds(self, x: Column) -> Column:
        return self.constraint.holds(x)

    def clip(self, x: Column) -> Column:
        return self.constraint.clip(x)


def infer_param_spec(name: str, link: str | None = None, constraint: Constraint | None = None) -> ParameterSpec:
    """Without a link: identity for mu and nu, log for the others."""
    link = link or ("identity" if name in ("mu", "nu") else "log")
    return ParameterSpec(name, link, constraint or BY_LINK.get(link, REAL))


def specs_from_names(names, constraints: dict | None = None, links: dict | None = None) -> list[ParameterSpec]:
    return [infer_param_spec(n, (links or {}).get(n), (constraints or {}).get(n)) for n in names]


def family_specs(family: str | Family) -> list[ParameterSpec]:
    f = resolve(family)
    return specs_from_names(f.parameters, links=f.links)


def response_constraint(family: str | Family) -> Constraint:
    """From the family's support and kind."""
    f = resolve(family)
    if f.support == "unit":
        return Constraint("unit", 0.0, 1.0, f.name in ("BEINF", "BEINF0", "BEZI"), f.name in ("BEINF", "BEINF1", "BEOI"))
    if f.support == "positive":
        return Constraint("positive", 0.0, closed_low=f.kind == "Mixed")
    if f.support == "above1":
        return Constraint("above1", 1.0)
    if f.support in ("count", "count1"):
        return Constraint(f.support, float(f.support == "count1"), closed_low=True, whole="bd" not in f.fixed)
    return REAL


def family_metadata(family: str | Family) -> dict:
    f = resolve(family)
    return {"family": f.name, "response": response_constraint(f), "parameters": {s.name: s.constraint for s in family_specs(f)}}


def invalid_responses(data: DataFrame, family: str | Family, y: Column) -> dict[str, int]:
    """Rows, null or NaN responses, infinite ones, and others outside the support: one aggregation."""
    y, c = y.cast("double"), response_constraint(family)
    missing = y.isNull() | F.isnan(y)
    infinite = ~missing & (F.abs(y) == float("inf"))
    row = data.agg(F.count("*").alias("rows"), F.count(F.when(missing, 1)).alias("missing"), F.count(F.when(infinite, 1)).alias("infinite"), F.count(F.when(~missing & ~infinite & ~c.holds(y), 1)).alias("outside")).first()
    return row.asDict()


def require_valid_responses(data: DataFrame, family: str | Family, y: Column) -> dict[str, int]:
    """Raises ValidationError where a response is infinite or outside the family's support."""
    n = invalid_responses(data, family, y)
    if n["infinite"]:
        raise ValidationError("finite", f"{n['infinite']} of {n['rows']} responses aren't finite")
    if n["outside"]:
        raise ValidationError("support", f"{n['outside']} of {n['rows']} responses are outside the support of {resolve(family).name} ({response_constraint(family).name})")
    return n


def require_valid_parameters(family: str | Family, values: dict) -> None:
    """Raises ValidationError where a parameter's values break its constraint."""
    for s in family_specs(family):
        if s.name in values and not s.constraint.check(values[s.name]).all():
            raise ValidationError("parameter", f"{s.name} must be {s.constraint.name}")


def validate_vector(name: str, x, n: int | None = None) -> np.ndarray:
    x = np.asarray(x, float)
    if x.ndim != 1 or n is not None and len(x) != n:
        raise ValidationError("shape", f"{name} has the shape {x.shape}")
    if not np.isfinite(x).all():
        raise ValidationError("finite", f"{name} isn't finite")
    return x


def validate_design_matrix(x, n: int | None = None) -> np.ndarray:
    x = np.asarray(x, float)
    if x.ndim != 2 or n is not None and len(x) != n:
        raise ValidationError("shape", f"the design has the shape {x.shape}")
    if not np.isfinite(x).all():
        raise ValidationError("finite", "the design isn't finite")
    return x
