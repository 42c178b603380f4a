"""Choosing families and terms: fits are independent jobs over the same cached rows; ranking is a small sort."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.families import resolve
from ..plans.formula import parse
from .fit import Model, gamlss
from .predict import with_log_density

#: Candidate families by kind of response.
CANDIDATES = {
    "realline": ["NO", "GU", "RG", "LO", "TF", "PE", "SN1", "SN2", "EXGAUS", "JSU", "SHASHO", "GT"],
    "realplus": ["EXP", "GA", "IG", "LOGNO", "WEI", "IGAMMA", "PARETO2", "GG", "BCCG", "BCT", "BCPE", "GB2"],
    "real0to1": ["BE", "LOGITNO", "SIMPLEX", "BEINF", "BEINF0", "BEINF1"],
    "counts": ["PO", "GEOM", "NBI", "NBII", "PIG", "WARING", "YULE", "ZIP", "ZIP2", "ZAP", "ZINBI", "DEL", "DPO"],
    "binom": ["BI", "BB", "ZIBI", "ZABI"],
}
CANDIDATES["realAll"] = CANDIDATES["realline"] + CANDIDATES["realplus"]


def data_type(data: DataFrame, column: str) -> str:
    """counts, real0to1, realplus or realline, by one aggregation."""
    c = F.col(column)
    row = data.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.max((c != F.floor(c)).cast("int")).alias("frac")).first()
    if row["lo"] is None or row["lo"] < 0:
        return "realline"
    return "counts" if not row["frac"] else "real0to1" if row["hi"] <= 1 else "realplus"


def compare_distributions(formula: str, data: DataFrame, families=None, criterion: float | str = "AIC", parallel: int = 4, **options) -> list[dict]:
    """A row per family, the best criterion first and failures last with an infinite one. Jobs of several fits share the cluster."""
    response = parse(formula).response
    names = families or CANDIDATES[data_type(data, response)]

    def one(name: str) -> dict:
        try:
            m = gamlss(formula, data, name, vcov=False, **options)
            k = {"AIC": 2.0, "BIC": math.log(m.n), "SBC": math.log(m.n)}.get(criterion, criterion)
            value = m.gaic(float(k))
            return {"family": resolve(name).name, "criterion": value if math.isfinite(value) else math.inf, "deviance": m.deviance, "df": m.df_fit, "converged": m.converged, "model": m, "error": ""}
        except Exception as e:  # noqa: BLE001  a family that can't be fitted is a row of the table
            return {"family": resolve(name).name, "criterion": math.inf, "deviance": math.inf, "df": math.nan, "converged": False, "model": None, "error": str(e)[:200]}

    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(one, names))
    return sorted(rows, key=lambda r: (r["criterion"], r["family"]))


def fit_dist(data: DataFrame, column: str, type: str | None = None, k: float = 2.0, extra=(), **options) -> list[dict]:
    """Intercept-only fits of the candidates of a kind, ranked by GAIC, then name."""
    names = [*dict.fromkeys([*CANDIDATES[type or data_type(data, column)], *extra])]
    return compare_distributions(f"{column} ~ 1", data, names, k, **options)


def select_best_distribution(formula: str, data: DataFrame, families=None, criterion="AIC", **options) -> Model:
    best = compare_distributions(formula, data, families, criterion, **options)[0]
    if best["model"] is None:
        raise ValueError("no family could be fitted: " + best["error"])
    return best["model"]


def choose_dist(formula: str, data: DataFrame, families=None, k=(2.0, 3.84), **options) -> list[dict]:
    """Rows of families with a GAIC per penalty, by the first one."""
    rows = compare_distributions(formula, data, families, k[0], **options)
    return [{"family": r["family"], **{f"k={x:g}": r["model"].gaic(x) if r["model"] else math.inf for x in k}} for r in rows]


def with_term(formula: str, term: str, add: bool) -> str:
    f = parse(formula)
    if add:
        return f"{f.text()} + {term}"
    left = [t.label for t in f.terms if t.label != term]
    return f"{f.response or ''} ~ {' + '.join(left) or '1'}{'' if f.intercept else ' - 1'}"


def _formulas(model: Model) -> dict[str, str]:
    return {p: model.designs[p].formula.text() for p in model.parameters}


def _fit(model: Model, formulas: dict[str, str], data: DataFrame | None = None) -> Model:
    first, *rest = model.parameters
    return gamlss(formulas[first], model.data if data is None else data, model.family, weights=model.weights, fixed=model.fixed, parameter_formula={p: "~" + formulas[p].split("~")[1] for p in rest}, vcov=False)


def _changes(model: Model, terms: list[str], what: str, add: bool, score) -> list[dict]:
    f = _formulas(model)

    def one(t: str) -> dict:
        m = _fit(model, f | {what: with_term(f[what], t, add)})
        return {"change": ("+ " if add else "- ") + t, "parameter": what, "value": score(m), "df": m.df_fit, "model": m}

    with ThreadPoolExecutor(4) as pool:
        return sorted(pool.map(one, terms), key=lambda r: (r["value"], r["change"]))


def dropterm(model: Model, scope=None, what: str = "mu", k: float = 2.0) -> list[dict]:
    return _changes(model, list(scope or [t.label for t in model.designs[what].formula.terms]), what, False, lambda m: m.gaic(k))


def addterm(model: Model, scope, what: str = "mu", k: float = 2.0) -> list[dict]:
    have = {t.label for t in model.designs[what].formula.terms}
    return _changes(model, [t for t in scope if t not in have], what, True, lambda m: m.gaic(k))


def _step(model: Model, scope, what_list, direction: str, score, margin: float = 1e-7, most: int = 100) -> tuple[Model, list[dict]]:
    trace = [{"change": "start", "value": score(model)}]
    for _ in range(most):
        options = []
        for what in what_list:
            have = [t.label for t in model.designs[what].formula.terms]
            if direction in ("both", "backward") and have:
                options += _changes(model, have, what, False, score)
            if direction in ("both", "forward"):
                options += _changes(model, [t for t in scope if t not in have], what, True, score)
        best = min(options, key=lambda r: (r["value"], r["change"]), default=None)
        if best is None or best["value"] >= trace[-1]["value"] - margin:
            return model, trace
        model = best["model"]
        trace.append({"change": best["change"], "parameter": best["parameter"], "value": best["value"]})
    return model, trace


def step_gaic(model: Model, scope, what: str = "mu", direction: str = "both", k: float = 2.0) -> tuple[Model, list[dict]]:
    """Greedy search over terms of one parameter."""
    return _step(model, scope, [what], direction, lambda m: m.gaic(k))


def step_gaic_all(model: Model, scope, parameters=None, direction: str = "both", k: float = 2.0) -> tuple[Model, list[dict]]:
    """Greedy search over the terms of all parameters."""
    return _step(model, scope, parameters or model.parameters, direction, lambda m: m.gaic(k))


def test_deviance(model: Model, newdata: DataFrame) -> float:
    """-2 log density summed over new rows (TGD)."""
    return -2 * with_log_density(model, newdata, "__l").agg(F.sum("__l")).first()[0]


def drop1_tgd(model: Model, newdata: DataFrame, scope=None, what: str = "mu") -> list[dict]:
    return _changes(model, list(scope or [t.label for t in model.designs[what].formula.terms]), what, False, lambda m: test_deviance(m, newdata))


def add1_tgd(model: Model, newdata: DataFrame, scope, what: str = "mu") -> list[dict]:
    have = {t.label for t in model.designs[what].formula.terms}
    return _changes(model, [t for t in scope if t not in have], what, True, lambda m: test_deviance(m, newdata))


def step_tgd(model: Model, newdata: DataFrame, scope, what: str = "mu", direction: str = "both") -> tuple[Model, list[dict]]:
    return _step(model, scope, [what], direction, lambda m: test_deviance(m, newdata))


def step_tgd_all(model: Model, newdata: DataFrame, scope, parameters=None, direction: str = "both") -> tuple[Model, list[dict]]:
    return _step(model, scope, parameters or model.parameters, direction, lambda m: test_deviance(m, newdata))


def gamlss_vgd(formula: str, data: DataFrame, family="NO", rand: str | None = None, newdata: DataFrame | None = None, **options) -> dict:
    """Fit on rand = 1, deviance on rand = 2 (or on newdata)."""
    train, test = (data.where(F.col(rand) == 1), data.where(F.col(rand) == 2)) if rand else (data, newdata)
    m = gamlss(formula, train, family, **options)
    return {"model": m, "vgd": test_deviance(m, test), "n": test.count()}


def gamlss_cv(formula: str, data: DataFrame, family="NO", folds: int = 10, fold: str | None = None, seed: int = 0, **options) -> dict:
    """Sum of the test deviances of the folds, by a fold column or a hash of all columns and the seed."""
    key = F.col(fold) if fold else F.pmod(F.xxhash64(*data.columns, F.lit(seed)), F.lit(folds))
    df = data.withColumn("__fold", key).persist()
    try:
        ids = sorted(r[0] for r in df.select("__fold").distinct().collect())

        def one(i) -> float:
            return test_deviance(gamlss(formula, df.where(F.col("__fold") != i), family, vcov=False, **options), df.where(F.col("__fold") == i))

        with ThreadPoolExecutor(4) as pool:
            parts = list(pool.map(one, ids))
    finally:
        df.unpersist()
    return {"cv": sum(parts), "folds": dict(zip(ids, parts, strict=True))}


#: Groups of families for the search by steps.
GROUPS = {
    "normal": ["NO", "LO", "GU", "RG"], "heavy": ["TF", "PE", "GT"], "skew": ["SN1", "SN2", "EXGAUS", "JSU", "SHASHO"], "positive": ["EXP", "GA", "IG", "LOGNO", "WEI"],
    "positive_shape": ["GG", "BCCG", "BCT", "BCPE", "GB2"], "unit": ["BE", "LOGITNO", "SIMPLEX"], "count": ["PO", "GEOM", "NBI", "NBII"], "count_zero": ["ZIP", "ZIP2", "ZAP", "ZINBI"],
}


def _allowed_groups(kind: str) -> list[str]:
    return {"realline": ["normal", "heavy", "skew"], "realplus": ["positive", "positive_shape", "normal"], "real0to1": ["unit"], "counts": ["count", "count_zero"]}[kind]


def stepwise_distribution_selection(formula: str, data: DataFrame, groups: dict[str, list[str]] | None = None, criterion: float | str = "AIC", **options) -> dict:
    """The first family of each group by criterion, then all families of the best group: {"best", "group", "groups", "families"}."""
    groups = groups or {g: GROUPS[g] for g in _allowed_groups(data_type(data, parse(formula).response))}
    first = compare_distributions(formula, data, [x[0] for x in groups.values()], criterion, **options)
    of = {resolve(x[0]).name: g for g, x in groups.items()}
    group = of[first[0]["family"]]
    rest = compare_distributions(formula, data, groups[group][1:], criterion, **options) if groups[group][1:] else []
    families = sorted([first[0], *rest], key=lambda r: (r["criterion"], r["family"]))
    return {"best": families[0]["model"], "group": group, "groups": first, "families": families}


def compare_by_validation(formula: str, data: DataFrame, newdata: DataFrame, families=None, parallel: int = 4, **options) -> list[dict]:
    """A row per family fitted on data, the smallest deviance of newdata first and failures last."""
    fits = compare_distributions(formula, data, families, "AIC", parallel, **options)
    for r in fits:
        r["validation"] = math.inf
        if r["model"] is not None:
            value = test_deviance(r["model"], newdata)
            r["validation"] = value if value is not None and math.isfinite(value) else math.inf
    return sorted(fits, key=lambda r: (r["validation"], r["family"]))


def _split(data: DataFrame, rand: str | None, newdata: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    if (rand is None) == (newdata is None):
        raise ValueError("give either rand, a column of 1 (fit) and 2 (validation), or newdata")
    return (data.where(F.col(rand) == 1), data.where(F.col(rand) == 2)) if rand else (data, newdata)


def gamlss_ml_pred(data: DataFrame, column: str, family="NO", rand: str | None = None, newdata: DataFrame | None = None, **options) -> dict:
    """An intercept-only fit on one part, and its deviance on the other: {"model", "validation", "n"}."""
    train, test = _split(data, rand, newdata)
    m = gamlss(f"{column} ~ 1", train, family, vcov=False, **options)
    return {"model": m, "validation": test_deviance(m, test), "n": test.count()}


def fit_dist_pred(data: DataFrame, column: str, type: str | None = None, rand: str | None = None, newdata: DataFrame | None = None, extra=(), **options) -> list[dict]:
    """Intercept-only fits of the candidates of a kind, ranked by the deviance of rows that weren't fitted."""
    train, test = _split(data, rand, newdata)
    names = [*dict.fromkeys([*CANDIDATES[type or data_type(train, column)], *extra])]
    return compare_by_validation(f"{column} ~ 1", train, test, names, **options)


def choose_dist_pred(model: Model, type: str | None = None, rand: str | None = None, newdata: DataFrame | None = None, extra=(), **options) -> list[dict]:
    """A fitted model's formulas with other families, ranked by the deviance of rows that weren't fitted."""
    train, test = _split(model.data, rand, newdata)
    names = [*dict.fromkeys([*CANDIDATES[type or data_type(train, model.response)], *extra])]
    f = _formulas(model)
    given = {p: "~" + x.split("~")[1] for p, x in f.items() if p != model.parameters[0]}
    rows = []
    for name in names:
        own = {p: x for p, x in given.items() if p in resolve(name).parameters}
        rows += compare_by_validation(f[model.parameters[0]], train, test, [name], parameter_formula=own, weights=model.weights, **options)
    return sorted(rows, key=lambda r: (r["validation"], r["family"]))


def vgd(*fits: dict) -> list[dict]:
    """Results of gamlss_vgd or gamlss_ml_pred by validation deviance: (index, family, df, validation)."""
    rows = [{"index": i, "family": f["model"].family.name, "df": f["model"].df_fit, "validation": f.get("vgd", f.get("validation"))} for i, f in enumerate(fits)]
    return sorted(rows, key=lambda r: (r["validation"], r["index"]))


def _all(model: Model, parameters, one) -> list[dict]:
    rows = [r for p in parameters or model.parameters for r in one(p)]
    return sorted(rows, key=lambda r: (r["value"], r["parameter"], r["change"]))


def dropterm_all(model: Model, parameters=None, k: float = 2.0) -> list[dict]:
    """dropterm over the terms of all parameters, in one table."""
    return _all(model, parameters, lambda p: dropterm(model, None, p, k) if model.designs[p].formula.terms else [])


def addterm_all(model: Model, scope, parameters=None, k: float = 2.0) -> list[dict]:
    return _all(model, parameters, lambda p: addterm(model, scope, p, k))


def drop1_tgd_all(model: Model, newdata: DataFrame, parameters=None) -> list[dict]:
    return _all(model, parameters, lambda p: drop1_tgd(model, newdata, None, p) if model.designs[p].formula.terms else [])


def add1_tgd_all(model: Model, newdata: DataFrame, scope, parameters=None) -> list[dict]:
    return _all(model, parameters, lambda p: add1_tgd(model, newdata, scope, p))


def drop1_tgdp(model: Model, newdata: DataFrame, parameter: str = "mu") -> list[dict]:
    return drop1_tgd(model, newdata, None, parameter)


def add1_tgdp(model: Model, newdata: DataFrame, scope, parameter: str = "mu") -> list[dict]:
    return add1_tgd(model, newdata, scope, parameter)
