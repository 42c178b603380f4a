"""Fitting: each update is one aggregation that returns sums of cross products; all else is small algebra on the driver.

Scores and Hessians on the predictor scale are derived symbolically from the family's log density. With few coefficients the
sums are built-in Column aggregates in generated code; with many, or for families without a closed form, each partition
reduces its Arrow batches to one row of partial sums. Methods: `CG` (all parameters at once, one job per iteration, with
cross derivatives), `RS` (parameter by parameter, with penalty selection), `MIXED` (RS, then CG), `LBFGS`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import diff, to_column, to_numpy, var, wrap
from ..functions.families import Family, resolve
from ..plans.formula import Design, Formula, design, expression, learn, parameter_formulas
from .smoothing import effective_df, lambda_for_df, select_lambda, solve

#: Cross products up to which the sums are Column aggregates.
COLUMN_SUMS = 90
#: Nodes of a family's expressions up to which they go into generated code, which is compiled anew for each iteration's
#: coefficients; larger ones cost more to compile than Arrow batches cost to move.
COLUMN_NODES = 200
#: What a special function counts as.
SPECIAL_NODES = {"lgamma": 20, "digamma": 25, "trigamma": 25, "ndtr": 40, "log_ndtr": 60, "ndtri": 120}


@dataclass
class Control:
    """tol: of the relative change of the deviance. cycles: of the outer loop. halvings: of a step that makes it worse."""

    tol: float = 1e-7
    cycles: int = 60
    halvings: int = 12
    trace: bool = False


@dataclass
class Sums:
    """loglik, score X'u, information X'WX, and for RS working sums X'Wz and z'Wz."""

    loglik: float
    score: np.ndarray
    info: np.ndarray
    xz: np.ndarray | None = None
    zz: float = 0.0


@dataclass
class Model:
    family: Family
    designs: dict[str, Design]
    coefficients: dict[str, np.ndarray]
    deviance: float
    penalised_df: float
    n: float
    iterations: int
    converged: bool
    method: str
    trace: list[tuple[int, float]] = field(default_factory=list)
    lambdas: dict[str, dict[str, list[float]]] = field(default_factory=dict)
    edf: dict[str, dict[str, float]] = field(default_factory=dict)
    vcov: np.ndarray | None = None
    fixed: dict[str, str] = field(default_factory=dict)
    weights: str | None = None
    data: DataFrame | None = None

    @property
    def response(self) -> str:
        return next(iter(self.designs.values())).formula.response

    @property
    def parameters(self) -> tuple[str, ...]:
        return self.family.parameters

    @property
    def df_fit(self) -> float:
        return self.penalised_df

    @property
    def aic(self) -> float:
        return self.gaic(2.0)

    @property
    def sbc(self) -> float:
        return self.gaic(math.log(max(self.n, 1)))

    def gaic(self, k: float = 2.0, c: bool = False) -> float:
        extra = 2 * self.df_fit * (self.df_fit + 1) / max(self.n - self.df_fit - 1, 1e-9) if c and k == 2 else 0.0
        return self.deviance + k * self.df_fit + extra

    def coef(self, parameter: str = "mu") -> dict[str, float]:
        return dict(zip(self.designs[parameter].names, map(float, self.coefficients[parameter]), strict=True))


def nodes(expressions: list) -> int:
    """Distinct nodes, special functions counting more."""
    seen, stack, n = set(), list(expressions), 0
    while stack:
        x = stack.pop()
        if id(x) not in seen:
            seen.add(id(x))
            n += SPECIAL_NODES.get(x.op, 1)
            stack += x.args
    return n


#: Log density of a row that has none under the current coefficients: such a step is never accepted.
IMPOSSIBLE = -1e12


def _finite(c: Column, other: float = 0.0) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), other).otherwise(c)


class Data:
    """The rows of a fit, projected to response, weight, fixed columns and the distinct design columns, and kept for all iterations."""

    def __init__(self, df: DataFrame, family: Family, designs: dict[str, Design], weights: str | None, fixed: dict[str, str], cache: bool = True):
        self.family, self.designs = family, designs
        self.params = family.parameters
        names: dict[str, int] = {}
        cols: list[Column] = []
        self.at: dict[str, list[int]] = {}
        for p, d in designs.items():
            self.at[p] = []
            for n, c in zip(d.names, d.columns, strict=True):
                if n not in names:
                    names[n] = len(cols)
                    cols.append(c)
                self.at[p].append(names[n])
        self.k = len(cols)
        y = expression(next(iter(designs.values())).formula.response)
        w = F.col(weights).cast("double") if weights else F.lit(1.0)
        fix = [F.col(fixed[f]).cast("double").alias(f) if f in fixed else F.lit(v).alias(f) for f, v in family.fixed.items()]
        self.rows = df.select(y.alias("y"), w.alias("w"), *fix, *[c.cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).where(" and ".join(f"{n} is not null and not isnan({n})" for n in ["y", "w", *family.fixed, *[f"x{i}" for i in range(len(cols))]]))
        self.cached = cache
        if cache:
            self.rows = self.rows.persist()
        self.sizes = [len(self.at[p]) for p in self.params]
        self.offsets = dict(zip(self.params, np.cumsum([0, *self.sizes[:-1]]).tolist(), strict=True))
        total = sum(self.sizes)
        self.by_column = False
        if family.logpdf is not None:
            self.e = family.log_density_eta()
            self.u = {p: diff(self.e, f"eta_{p}") for p in self.params}
            self.h = {(p, q): diff(self.u[p], f"eta_{q}") for i, p in enumerate(self.params) for q in self.params[i:]}
            self.by_column = total * (total + 1) // 2 <= COLUMN_SUMS and nodes([self.e, *self.u.values(), *self.h.values()]) <= COLUMN_NODES

    def close(self) -> None:
        if self.cached:
            self.rows.unpersist()

    def moments(self) -> dict:
        y, w = F.col("y"), F.col("w")
        r = self.rows
        ly = F.when(y > 0, F.log(y))
        row = r.agg(F.sum("w").alias("n"), (F.sum(w * y) / F.sum("w")).alias("m"), F.var_pop("y").alias("v"), F.avg(ly).alias("lm"), F.var_pop(ly).alias("lv"), F.avg((y == 0).cast("double")).alias("p0"), F.avg((y == 1).cast("double")).alias("p1"), F.max("y").alias("max"), *[F.avg(f).alias(f) for f in self.family.fixed]).first()
        return {k: (0.0 if v is None else float(v)) for k, v in row.asDict().items()}

    def etas(self, beta: dict[str, np.ndarray]) -> dict[str, Column]:
        out = {}
        for p in self.params:
            eta = F.lit(0.0)
            for i, b in zip(self.at[p], beta[p], strict=True):
                eta = eta + F.lit(float(b)) * F.col(f"x{i}")
            out[p] = eta
        return out

    def sums(self, beta: dict[str, np.ndarray], which: tuple[str, ...], working: bool = False) -> Sums:
        """One job. which: the parameters whose scores and information blocks are wanted. working: RS's form for one of them."""
        return self._by_column(beta, which, working) if self.by_column else self._by_batch(beta, which, working)

    def _by_column(self, beta, which, working) -> Sums:
        eta = self.rows.select("*", *[c.alias(f"eta_{p}") for p, c in self.etas(beta).items()])
        values = {f"eta_{p}": F.col(f"eta_{p}") for p in self.params} | {"y": F.col("y"), **{f: F.col(f) for f in self.family.fixed}}
        memo: dict = {}
        pairs = [(p, q) for i, p in enumerate(which) for q in which[i:]]
        cols = [_finite(to_column(self.e, values, memo), IMPOSSIBLE).alias("ll")]
        cols += [_finite(to_column(self.u[p], values, memo)).alias(f"u_{p}") for p in which]
        cols += [_finite(-to_column(self.h[(p, q)], values, memo)).alias(f"h_{p}_{q}") for p, q in pairs]
        row = eta.select("w", *[f"x{i}" for i in range(self.k)], *[f"eta_{p}" for p in self.params], *cols)
        w = F.col("w")
        agg = [F.sum(w * F.col("ll")).alias("ll")]
        for p in which:
            agg += [F.sum(w * F.col(f"u_{p}") * F.col(f"x{i}")).alias(f"g_{p}_{i}") for i in dict.fromkeys(self.at[p])]
        if working:
            p = which[0]
            row = row.withColumn(f"h_{p}_{p}", F.when(F.col(f"h_{p}_{p}") > 1e-10, F.col(f"h_{p}_{p}")).otherwise(F.greatest(F.col(f"u_{p}") * F.col(f"u_{p}"), F.lit(1e-10))))
            z = F.col(f"eta_{p}") + F.col(f"u_{p}") / F.col(f"h_{p}_{p}")
            agg += [F.sum(w * F.col(f"h_{p}_{p}") * z * z).alias("zz")]
        for p, q in pairs:
            seen = set()
            for i in self.at[p]:
                for j in self.at[q]:
                    key = (min(i, j), max(i, j))
                    if key not in seen:
                        seen.add(key)
                        agg.append(F.sum(w * F.col(f"h_{p}_{q}") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"i_{p}_{q}_{key[0]}_{key[1]}"))
        got = row.agg(*agg).first().asDict()
        score = np.concatenate([[got[f"g_{p}_{i}"] or 0.0 for i in self.at[p]] for p in which])
        blocks = [[np.array([[got[f"i_{p}_{q}_{min(i, j)}_{max(i, j)}"] or 0.0 for j in self.at[q]] for i in self.at[p]]).reshape(len(self.at[p]), len(self.at[q])) if which.index(q) >= which.index(p) else None for q in which] for p in which]
        info = np.block([[blocks[a][b] if b >= a else blocks[b][a].T for b in range(len(which))] for a in range(len(which))])
        return self._finish(got["ll"] or 0.0, score, info, got.get("zz"), beta, which, working)

    def _by_batch(self, beta, which, working) -> Sums:
        run = batch_sums(self, beta, which, working)
        size = sum(len(self.at[p]) for p in which)
        rows = self.rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        v = np.zeros(2 + size + size * size)
        for r in rows:
            v[r["i"]] = r["v"]
        return self._finish(v[0], v[2 : 2 + size], v[2 + size :].reshape(size, size), v[1], beta, which, working)

    def _finish(self, ll, score, info, zz, beta, which, working) -> Sums:
        if not working:
            return Sums(ll, score, info)
        return Sums(ll, score, info, info @ beta[which[0]] + score, zz or 0.0)


def row_terms(family: Family, e, u, h, params, values: dict, which, n: int):
    """(loglik, scores, second derivatives) of rows in numpy; by differences where the family has no expression."""
    if e is not None:
        memo: dict = {}
        full = lambda x: np.broadcast_to(np.asarray(to_numpy(x, values, memo), float), (n,))
        return full(e), {p: full(u[p]) for p in which}, {(p, q): full(h[(p, q)]) for i, p in enumerate(which) for q in which[i:]}
    links = {p: family.link(p).inverse(var("e")) for p in params}

    def ll(shift: dict):
        q = {p: np.broadcast_to(np.asarray(to_numpy(links[p], {"e": values[f"eta_{p}"] + shift.get(p, 0.0)}), float), (n,)) for p in params}
        with np.errstate(all="ignore"):
            return family.np_logpdf(values["y"], **q, **{f: values[f] for f in family.fixed})

    d, base = 1e-4, ll({})
    up, down = {p: ll({p: d}) for p in which}, {p: ll({p: -d}) for p in which}
    second = {(p, p): (up[p] - 2 * base + down[p]) / d**2 for p in which}
    for i, p in enumerate(which):
        for q in which[i + 1 :]:
            second[(p, q)] = (ll({p: d, q: d}) - ll({p: d, q: -d}) - ll({p: -d, q: d}) + ll({p: -d, q: -d})) / (4 * d * d)
    return base, {p: (up[p] - down[p]) / (2 * d) for p in which}, second


def batch_sums(data: Data, beta, which, working):
    family, params, at, k = data.family, data.params, data.at, data.k
    e, u, h = (data.e, data.u, data.h) if family.logpdf is not None else (None, None, None)

    def run(batches):
        total = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = {name: c.to_numpy(zero_copy_only=False) for name, c in zip(batch.schema.names, batch.columns, strict=True)}
            part = numpy_sums(family, e, u, h, params, which, working, col, {p: np.stack([col[f"x{i}"] for i in at[p]], axis=1) if at[p] else np.zeros((n, 0)) for p in params}, beta)
            total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

    del k
    return run


def numpy_sums(family, e, u, h, params, which, working, col, xs, beta) -> np.ndarray:
    """[loglik, z'Wz, X'u, X'WX row by row] of a batch."""
    n, w = len(col["y"]), col["w"]
    eta = {p: xs[p] @ beta[p] for p in params}
    values = {"y": col["y"], **{f: col[f] for f in family.fixed}, **{f"eta_{p}": v for p, v in eta.items()}}
    ll, du, dh = row_terms(family, e, u, h, params, values, which, n)
    clean = lambda x: np.where(np.isfinite(x), x, 0.0)
    du, dh = {p: clean(v) for p, v in du.items()}, {k: clean(-v) for k, v in dh.items()}
    zz = 0.0
    if working:
        p = which[0]
        dh[(p, p)] = np.where(dh[(p, p)] > 1e-10, dh[(p, p)], np.maximum(du[p] ** 2, 1e-10))
        zz = float((w * dh[(p, p)] * (eta[p] + du[p] / dh[(p, p)]) ** 2).sum())
    score = np.concatenate([xs[p].T @ (w * du[p]) for p in which])
    info = np.block([[xs[p].T @ ((w * (dh[(p, q)] if (p, q) in dh else dh[(q, p)]))[:, None] * xs[q]) for q in which] for p in which])
    return np.concatenate(([float((w * np.where(np.isfinite(ll), ll, IMPOSSIBLE)).sum()), zz], score, info.ravel()))


class LocalData:
    """The same sums over numpy arrays: for one group, or one bootstrap sample, inside a task."""

    def __init__(self, family: Family, y, xs: dict[str, np.ndarray], w=None, fixed=None):
        self.family, self.params, self.xs = family, family.parameters, xs
        y = np.asarray(y, float)
        self.col = {"y": y, "w": np.ones(len(y)) if w is None else np.asarray(w, float)} | {f: np.broadcast_to(np.asarray((fixed or {}).get(f, v), float), y.shape) for f, v in family.fixed.items()}
        self.at = {p: list(range(xs[p].shape[1])) for p in self.params}
        self.e = self.u = self.h = None
        if family.logpdf is not None:
            self.e = family.log_density_eta()
            self.u = {p: diff(self.e, f"eta_{p}") for p in self.params}
            self.h = {(p, q): diff(self.u[p], f"eta_{q}") for i, p in enumerate(self.params) for q in self.params[i:]}

    def moments(self) -> dict:
        y, w = self.col["y"], self.col["w"]
        pos = y[y > 0]
        return {"n": w.sum(), "m": float(np.average(y, weights=w)), "v": float(y.var()), "lm": float(np.log(pos).mean()) if len(pos) else 0.0, "lv": float(np.log(pos).var()) if len(pos) else 0.0, "p0": float((y == 0).mean()), "p1": float((y == 1).mean()), "max": float(y.max())} | {f: float(self.col[f].mean()) for f in self.family.fixed}

    def sums(self, beta, which, working=False) -> Sums:
        v = numpy_sums(self.family, self.e, self.u, self.h, self.params, which, working, self.col, self.xs, beta)
        size = sum(self.xs[p].shape[1] for p in which)
        score, info = v[2 : 2 + size], v[2 + size :].reshape(size, size)
        return Sums(v[0], score, info, info @ beta[which[0]] + score, v[1]) if working else Sums(v[0], score, info)

    def close(self) -> None:
        pass


def starts(family: Family, moments: dict, intercepts: dict[str, int | None], sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """Intercepts at the links of moment estimates, all else 0."""
    values = (family.start(moments) if family.start else {}) or {}
    beta = {}
    for p in family.parameters:
        b = np.zeros(sizes[p])
        link = family.links[p]
        v = values.get(p, {"identity": moments["m"] if p == "mu" else 0.0, "log": 1.0, "logit": 0.5, "logshift2": 10.0}.get(link, 0.5))
        if intercepts[p] is not None:
            eta = float(to_numpy(family.link(p).link(wrap(float(v))), {}))
            b[intercepts[p]] = eta if math.isfinite(eta) else 0.0
        beta[p] = b
    return beta


def _joined(beta, params):
    return np.concatenate([beta[p] for p in params])


def _parted(v, params, sizes):
    return dict(zip(params, np.split(v, np.cumsum([sizes[p] for p in params])[:-1]), strict=True))


def newton(data, beta, control: Control, penalty: np.ndarray | None = None):
    """All parameters at once by damped Newton steps; one job each, a halving is one more. Returns (beta, sums, iterations, converged, trace)."""
    params = data.params
    sizes = {p: len(beta[p]) for p in params}
    pen = np.zeros((sum(sizes.values()),) * 2) if penalty is None else penalty
    value = lambda s, b: s.loglik - 0.5 * b @ pen @ b
    b = _joined(beta, params)
    s, damp, trace = data.sums(beta, params), 0.0, []
    for it in range(1, control.cycles + 1):
        trace.append((it, -2 * s.loglik))
        info = s.info + pen
        scale = np.sqrt(np.maximum(np.abs(np.diag(info)), 1e-12))
        low = np.linalg.eigvalsh(info / scale[:, None] / scale[None])[0]
        lift = max(damp, (1e-8 - low) * 1.5 if low < 1e-8 else 0.0)
        step = solve(info + lift * np.diag(scale**2), s.score - pen @ b)
        if not np.isfinite(step).all():
            return beta, s, it, False, trace
        done = False
        for k in range(control.halvings):
            cand = b + step / 2**k
            new = data.sums(_parted(cand, params, sizes), params)
            if math.isfinite(new.loglik) and value(new, cand) >= value(s, b) - 1e-10 * (1 + abs(s.loglik)):
                done = True
                break
        if not done:
            if damp >= 1e4:
                return beta, s, it, False, trace
            damp = max(damp * 10, 0.1)
            continue
        gain = value(new, cand) - value(s, b)
        b, s, beta = cand, new, _parted(cand, params, sizes)
        damp = damp / 10 if damp > 1e-3 else 0.0
        if abs(gain) <= control.tol * (0.1 + abs(s.loglik)) and damp == 0.0:
            return beta, s, it, True, [*trace, (it + 1, -2 * s.loglik)]
    return beta, s, control.cycles, False, trace


def alternating(data, beta, control: Control, designs: dict[str, Design], criterion: str = "GCV"):
    """RS: one weighted least squares step per parameter and cycle, penalties chosen from the step's cross products."""
    params = data.params
    pens = {p: _penalties(designs[p]) if designs else [] for p in params}
    lams = {p: [1.0] * len(pens[p]) for p in params}
    trace, last, previous, n = [], None, None, data.moments()["n"]
    step_from: dict[str, np.ndarray] = {}
    ahead = None  # the sums that gave a cycle's deviance are those of the next cycle's first step
    for it in range(1, control.cycles + 1):
        for p in params:
            s, ahead = ahead or data.sums(beta, (p,), working=True), None
            halved = 0
            while last is not None and previous is not None and not pens[previous] and s.loglik < last - 1e-8 * (1 + abs(last)) and halved < control.halvings:
                beta[previous] = (beta[previous] + step_from[previous]) / 2
                s, halved = data.sums(beta, (p,), working=True), halved + 1
            last = s.loglik
            total = np.zeros_like(s.info)
            if pens[p]:
                lams[p] = _choose(s, n, pens[p], lams[p], designs[p], criterion)
                total = sum(x * m for x, (_, m) in zip(lams[p], pens[p], strict=True)) + 1e-7 * np.diag(np.diag(s.info))
            step_from[p] = beta[p].copy()
            beta = beta | {p: solve(s.info + total, s.xz)}
            previous = p
        ahead = data.sums(beta, (params[0],), working=True)
        now = ahead.loglik
        trace.append((it, -2 * now))
        if len(trace) > 1 and abs(trace[-1][1] - trace[-2][1]) <= max(control.tol, 1e-6 if any(pens.values()) else 0) * (0.1 + abs(trace[-1][1])):
            return beta, lams, it, True, trace
    return beta, lams, control.cycles, False, trace


def _penalties(d: Design) -> list[tuple[str, np.ndarray]]:
    out = []
    for b, sl in zip(d.blocks, d.slices(), strict=True):
        for m in b.penalties:
            full = np.zeros((len(d.names),) * 2)
            full[sl, sl] = m / max(np.abs(m).max(), 1e-300)
            out.append((b.label, full))
    return out


def _choose(s: Sums, n: float, pens, lams, d: Design, criterion: str) -> list[float]:
    mats = [m * max(np.trace(s.info) / len(s.info), 1e-300) for _, m in pens]
    unit = [max(np.trace(s.info) / len(s.info), 1e-300)] * len(pens)
    options = {b.label: b.options for b in d.blocks}
    ridge = 1e-7 * np.diag(np.diag(s.info))
    fixed = {}
    for k, (label, _) in enumerate(pens):
        o = options[label]
        if "lambda" in o or "lambda_" in o:
            fixed[k] = float(o.get("lambda", o.get("lambda_")))
        elif "df" in o:
            sl = next(x for b, x in zip(d.blocks, d.slices(), strict=True) if b.label == label)
            fixed[k] = unit[k] * lambda_for_df(s.info[sl, sl] + 1e-9 * np.diag(np.diag(s.info[sl, sl])), mats[k][sl, sl], float(o["df"]) + 2)
    free = [k for k in range(len(pens)) if k not in fixed]
    out = list(lams)
    for k, v in fixed.items():
        out[k] = v
    if free:
        base = sum((out[k] * pens[k][1] for k in fixed), np.zeros_like(s.info)) + ridge
        method = next((str(options[pens[k][0]].get("method", criterion)).upper() for k in free), criterion)
        method = method if method in ("GCV", "REML", "ML", "AIC", "GAIC", "BIC", "UBRE") else criterion
        got = select_lambda(s.info + base, s.xz, s.zz, n, [mats[k] for k in free], method)
        for k, v in zip(free, got, strict=True):
            out[k] = v * unit[k]
    return out


def lbfgs(data, beta, control: Control, history: int = 12):
    """Limited-memory quasi-Newton on all coefficients; the score comes from the same job as the likelihood."""
    params = data.params
    sizes = {p: len(beta[p]) for p in params}
    b = _joined(beta, params)
    first = data.sums(beta, params)
    scale = 1 / np.sqrt(np.maximum(np.abs(np.diag(first.info)), 1e-12))
    f, g = -first.loglik, -first.score * scale
    pairs: list = []
    trace = []
    for it in range(1, control.cycles * 5 + 1):
        trace.append((it, 2 * f))
        q, alphas = g.copy(), []
        for s_, y_ in reversed(pairs):
            a = (s_ @ q) / (y_ @ s_)
            alphas.append(a)
            q -= a * y_
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1.0
        for (s_, y_), a in zip(pairs, reversed(alphas), strict=True):
            q += s_ * (a - (y_ @ q) / (y_ @ s_))
        t, ok = 1.0, False
        for _ in range(25):
            cand = b - t * scale * q
            new = data.sums(_parted(cand, params, sizes), params)
            if math.isfinite(new.loglik) and -new.loglik <= f - 1e-4 * t * (g @ q):
                ok = True
                break
            t /= 2
        if not ok:
            return _parted(b, params, sizes), first, it, bool(pairs), trace
        g2 = -new.score * scale
        s_, y_ = (cand - b) / scale, g2 - g
        if s_ @ y_ > 1e-12:
            pairs = [*pairs[-history + 1 :], (s_, y_)]
        gain, b, f, g, first = f + new.loglik, cand, -new.loglik, g2, new
        if gain <= control.tol * 1e-2 * (0.1 + abs(f)):
            return _parted(b, params, sizes), first, it, True, trace
    return _parted(b, params, sizes), first, it, False, trace


def gamlss(formula: str, data: DataFrame, family: str | Family | None = "NO", sigma_formula: str | None = None, nu_formula: str | None = None, tau_formula: str | None = None, method: str = "AUTO", weights: str | None = None, fixed: dict[str, str] | None = None, control: Control | None = None, criterion: str = "GCV", parameter_formula: dict[str, str] | None = None, vcov: bool = True) -> Model:
    """Fits a distributional regression.

    Rows with a null or NaN in any used column are left out. method AUTO: RS where a formula has a smooth term, else CG with
    RS as a second attempt. fixed: the family's fixed parameter (bd, event) -> column. An empty table raises ValueError.
    """
    fam, control = resolve(family), control or Control()
    given = {"sigma": sigma_formula, "nu": nu_formula, "tau": tau_formula} | (parameter_formula or {})
    formulas = parameter_formulas(formula, fam.parameters, given)
    if not formulas[fam.parameters[0]].response:
        raise ValueError("the first formula needs a response")
    levels, ranges = learn(data, list(formulas.values()))
    designs = {p: design(f, levels, ranges) for p, f in formulas.items()}
    return fit_designs(data, fam, designs, method, weights, fixed or {}, control, criterion, vcov)


def fit_designs(data: DataFrame, fam: Family, designs: dict[str, Design], method: str = "AUTO", weights: str | None = None, fixed: dict[str, str] | None = None, control: Control | None = None, criterion: str = "GCV", vcov: bool = True) -> Model:
    control = control or Control()
    rows = Data(data, fam, designs, weights, fixed or {})
    try:
        return _fitted(rows, fam, designs, method.upper(), weights, fixed or {}, control, criterion, vcov, data)
    finally:
        rows.close()


def _fitted(rows, fam, designs, method, weights, fixed, control, criterion, vcov, data) -> Model:
    moments = rows.moments()
    if not moments["n"]:
        raise ValueError("no complete rows to fit")
    smooth = any(d.formula.smooth for d in designs.values())
    if method not in ("AUTO", "RS", "CG", "MIXED", "JOINT", "LBFGS"):
        raise ValueError(f"unknown method {method!r}")
    used = "RS" if smooth or method == "RS" else "LBFGS" if method in ("LBFGS", "JOINT") else "MIXED" if method == "MIXED" else "CG"
    beta = starts(fam, moments, {p: d.names.index("(Intercept)") if "(Intercept)" in d.names else None for p, d in designs.items()}, {p: len(d.names) for p, d in designs.items()})
    lams = {p: [] for p in fam.parameters}
    total_df = float(sum(len(d.names) for d in designs.values()))
    if used == "RS" or used == "MIXED":
        beta, lams, it, ok, trace = alternating(rows, beta, control, designs, criterion)
        s = None
    if used in ("CG", "MIXED"):
        beta, s, it, ok, trace = newton(rows, beta, control)
        if not ok and used == "CG" and method == "AUTO":
            beta, lams, it, ok, trace = alternating(rows, beta, control, designs, criterion)
            used, s = "RS", None
    if used == "LBFGS":
        beta, s, it, ok, trace = lbfgs(rows, beta, control)
    s = s or rows.sums(beta, rows.params)
    pen = np.zeros_like(s.info)
    edf: dict = {p: {} for p in fam.parameters}
    lam_out: dict = {p: {} for p in fam.parameters}
    at = 0
    for p in fam.parameters:
        d, pens = designs[p], _penalties(designs[p])
        size = len(d.names)
        block = s.info[at : at + size, at : at + size]
        if pens:
            own = sum(x * m for x, (_, m) in zip(lams[p], pens, strict=True)) + 1e-7 * np.diag(np.maximum(np.diag(block), 0))
            pen[at : at + size, at : at + size] = own
            hat = solve(block + own, block)
            total_df += effective_df(block, own) - size
            for b, sl in zip(d.blocks, d.slices(), strict=True):
                if b.penalties:
                    edf[p][b.label] = float(np.trace(hat[sl, sl]))
            for x, (label, _) in zip(lams[p], pens, strict=True):
                lam_out[p].setdefault(label, []).append(float(x))
        at += size
    cov = solve(s.info + pen, np.eye(len(s.info))) if vcov and len(s.info) else None
    return Model(fam, designs, beta, -2 * s.loglik, total_df, moments["n"], it, ok, used, trace, lam_out, edf, cov, fixed, weights, data)


def gamlss_ml(formula: str, data: DataFrame, family="NO", **more) -> Model:
    """Maximum likelihood by joint Newton steps."""
    return gamlss(formula, data, family, method="CG", **more)


def fit_local(family, y, xs: dict[str, np.ndarray] | None = None, w=None, fixed=None, control: Control | None = None, start: dict | None = None) -> tuple[dict[str, np.ndarray], float, bool]:
    """(coefficients, deviance, converged) of a fit over arrays in one task; intercepts only where xs has no matrix."""
    fam = resolve(family)
    n = len(y)
    xs = {p: (xs or {}).get(p, np.ones((n, 1))) for p in fam.parameters}
    local = LocalData(fam, y, xs, w, fixed)
    first = {p: next((j for j in range(x.shape[1]) if np.all(x[:, j] == 1)), None) for p, x in xs.items()}
    beta = start or starts(fam, local.moments(), first, {p: x.shape[1] for p, x in xs.items()})
    beta, s, _, ok, _ = newton(local, beta, control or Control())
    return beta, -2 * s.loglik, ok


def fit_groups(data: DataFrame, by: str, formula: str, family="NO", sigma_formula: str | None = None, nu_formula: str | None = None, tau_formula: str | None = None, task_rows: int = 1_000_000) -> DataFrame:
    """Independent fits of many groups: (by, parameter, term, estimate, deviance, converged).

    A group of up to task_rows rows is one task's work. Larger ones, of which there are at most so many times fewer than
    rows, are fitted one after another by distributed sums, so that no task gets a large group. A null group takes no part.
    """
    fam = resolve(family)
    formulas = parameter_formulas(formula, fam.parameters, {"sigma": sigma_formula, "nu": nu_formula, "tau": tau_formula})
    levels, ranges = learn(data, list(formulas.values()))
    designs = {p: design(f, levels, ranges) for p, f in formulas.items()}
    names = {p: d.names for p, d in designs.items()}
    cols = [c.cast("double").alias(f"{p}__{j}") for p, d in designs.items() for j, c in enumerate(d.columns)]
    kind = data.schema[by].dataType.simpleString()
    y = expression(formulas[fam.parameters[0]].response)

    def one(key, pdf):
        import pandas as pd

        xs = {p: pdf[[f"{p}__{j}" for j in range(len(n))]].to_numpy(float) for p, n in names.items()}
        try:
            beta, dev, ok = fit_local(fam, pdf["__y"].to_numpy(float), xs)
        except (ValueError, np.linalg.LinAlgError):
            beta, dev, ok = {p: np.full(len(n), np.nan) for p, n in names.items()}, float("nan"), False
        return pd.DataFrame([(key[0], p, t, float(b), float(dev), bool(ok)) for p, n in names.items() for t, b in zip(n, beta[p], strict=True)], columns=["g", "parameter", "term", "estimate", "deviance", "converged"])

    schema = f"g {kind}, parameter string, term string, estimate double, deviance double, converged boolean"
    large = [r[0] for r in data.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > task_rows).select(by).collect()]
    rest = data.where(~F.col(by).isin(large)) if large else data
    out = rest.select(F.col(by), y.alias("__y"), *cols).dropna().groupBy(by).applyInPandas(one, schema)
    rows = []
    for g in large:
        try:
            m = fit_designs(data.where(F.col(by) == F.lit(g)), fam, designs, vcov=False)
            rows += [(g, p, t, float(b), float(m.deviance), bool(m.converged)) for p, n in names.items() for t, b in zip(n, m.coefficients[p], strict=True)]
        except (ValueError, np.linalg.LinAlgError):
            rows += [(g, p, t, float("nan"), float("nan"), False) for p, n in names.items() for t in n]
    if rows:
        out = out.unionByName(data.sparkSession.createDataFrame(rows, schema))
    return out.withColumnRenamed("g", by)


def formula_of(model: Model, parameter: str) -> Formula:
    return model.designs[parameter].formula
