"""What each family supports, derived from its definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.dist import NUMPY_CDF
from ..functions.families import list_families, resolve

FEATURES = ("density", "score", "cdf", "quantile", "sample", "rs", "cg", "smooth", "streaming")
#: How a feature may be computed to count as supported.
ROUTES = {f: ("native", "arrow", "numeric") for f in FEATURES} | {"streaming": ("native", "arrow")}
#: Fitting methods, and the features that each needs.
METHODS = {"CG": ("density", "score", "cg"), "RS": ("density", "score", "rs"), "MIXED": ("density", "score", "rs", "cg"), "LBFGS": ("density", "score", "cg")}


def family_capability(name: str) -> dict[str, str]:
    """Feature -> native (Columns), arrow (batches) or numeric (by differences, sums or bisection)."""
    f = resolve(name)
    density = "native" if f.logpdf is not None else "arrow"
    cdf = "native" if f.cdf is not None else "arrow" if f.name in NUMPY_CDF else "numeric"
    quantile = "native" if f.quantile is not None else "numeric"
    score = "native" if f.logpdf is not None else "numeric"
    return {"family": f.name, "kind": f.kind, "status": f.status, "density": density, "score": score, "cdf": cdf, "quantile": quantile, "sample": quantile, "rs": score, "cg": score, "smooth": score, "streaming": density}


def capability_matrix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([family_capability(n) for n in list_families()])


def family_supports(name: str, feature: str, include_experimental: bool = True) -> bool:
    if feature not in FEATURES:
        raise ValueError(f"unknown feature {feature!r}; known: {FEATURES}")
    return family_capability(name)[feature] in ROUTES[feature] and (include_experimental or resolve(name).status == "stable")


def require_family_capability(name: str, feature: str, allow_experimental: bool = False) -> None:
    if not family_supports(name, feature, allow_experimental):
        raise ValueError(f"{name} is experimental; allow_experimental=True fits it all the same")


def method_route_report(name: str, method: str, strict: bool = False) -> dict:
    """Whether a family can be fitted by a method, and what is missing; strict: stable families with native scores only."""
    if method.upper() not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {sorted(METHODS)}")
    have = family_capability(name)
    missing = [f for f in METHODS[method.upper()] if have[f] not in ROUTES[f] or strict and have[f] != "native"]
    blocked = bool(missing) or strict and have["status"] != "stable"
    return {"family": have["family"], "method": method.upper(), "status": have["status"], "admitted": not blocked, "missing": missing}


def require_method_route(name: str, method: str, allow_experimental: bool = False) -> None:
    r = method_route_report(name, method)
    if not r["admitted"] or not allow_experimental and r["status"] != "stable":
        raise ValueError(f"{r['family']} can't be fitted by {r['method']}: {r['missing'] or r['status']}")


def capability_differences(spark: SparkSession, saved: list[dict]) -> DataFrame:
    """(family, feature, saved, current) where a saved matrix and the present one differ, either way."""
    rows = lambda x: [(r["family"], k, str(v)) for r in x for k, v in r.items() if k != "family"]
    a = spark.createDataFrame(rows(saved), "family string, feature string, saved string")
    b = spark.createDataFrame(rows([family_capability(n) for n in list_families()]), "family string, feature string, current string")
    return a.join(b, ["family", "feature"], "full").where("not (saved <=> current)")
