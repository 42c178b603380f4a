"""Ridge, lasso and elastic net from one cross-product aggregation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, y: str, xs: list[str], by: str | None = None):
    """n, means, centred X'X, X'y and y'y: two jobs, so that large means don't cancel. by: per value of a column, as a dict."""
    m = df.agg(*[F.avg(c).alias(c) for c in [*xs, y]]).first().asDict()
    c = {v: F.col(v).cast("double") - F.lit(float(m[v])) for v in [*xs, y]}
    names = [*xs, y]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    aggs = [F.count("*").alias("n"), *[F.sum(c[v]).alias(f"s_{v}") for v in names], *[F.sum(c[a] * c[b]).alias(f"{a}__{b}") for a, b in pairs]]
    rows = (df.groupBy(by) if by else df.groupBy()).agg(*aggs).collect()

    def made(r) -> dict:
        full = np.array([[r[f"{a}__{b}"] if (a, b) in pairs else r[f"{b}__{a}"] for b in names] for a in names], float)
        return {"n": r["n"], "s": np.array([r[f"s_{v}"] for v in names], float), "full": full, "means": np.array([m[v] for v in names], float)}

    return {r[by]: made(r) for r in rows} if by else made(rows[0])


def _centred(g: dict) -> tuple[np.ndarray, np.ndarray, float]:
    m = g["full"] - np.outer(g["s"], g["s"]) / g["n"]
    return m[:-1, :-1], m[:-1, -1], m[-1, -1]


def soft_threshold(x, t: float):
    return np.sign(x) * np.maximum(np.abs(x) - t, 0.0)


def l1_penalty(b, lam: float) -> float:
    return float(lam * np.abs(b).sum())


def l2_penalty(b, lam: float) -> float:
    return float(lam * np.square(b).sum())


def elastic_net_penalty(b, lam: float, alpha: float = 0.5) -> float:
    return alpha * l1_penalty(b, lam) + (1 - alpha) * l2_penalty(b, lam) / 2


def elastic_net_solve(xx, xy, n: float, lam: float, alpha: float, tol: float = 1e-12, sweeps: int = 5000) -> np.ndarray:
    """Coordinate descent on 1 / (2 n) |y - Xb|^2 + lam (alpha |b|_1 + (1 - alpha) / 2 |b|^2), from cross products."""
    b = np.zeros(len(xy))
    for _ in range(sweeps):
        before = b.copy()
        for j in range(len(b)):
            if xx[j, j] > 0:
                r = (xy[j] - xx[j] @ b + xx[j, j] * b[j]) / n
                b[j] = soft_threshold(r, lam * alpha) / (xx[j, j] / n + lam * (1 - alpha))
        if np.abs(b - before).max(initial=0) < tol:
            break
    return b


def _result(g: dict, b: np.ndarray) -> dict:
    return {"coef": b, "intercept": float(g["means"][-1] + g["s"][-1] / g["n"] - (g["means"][:-1] + g["s"][:-1] / g["n"]) @ b)}


def fit_ridge(df: DataFrame, y: str, xs: list[str], lam: float) -> dict:
    """(X'X + lam I)^-1 X'y, centred."""
    g = gram(df, y, xs)
    xx, xy, _ = _centred(g)
    return _result(g, np.linalg.solve(xx + lam * np.eye(len(xs)), xy))


def fit_elastic_net(df: DataFrame, y: str, xs: list[str], lam: float, alpha: float = 0.5) -> dict:
    g = gram(df, y, xs)
    xx, xy, _ = _centred(g)
    return _result(g, elastic_net_solve(xx, xy, g["n"], lam, alpha))


def fit_lasso(df: DataFrame, y: str, xs: list[str], lam: float) -> dict:
    return fit_elastic_net(df, y, xs, lam, 1.0)


def cross_validate_lambda(df: DataFrame, y: str, xs: list[str], grid=None, alpha: float = 1.0, folds: int = 5, seed: int = 0) -> dict:
    """Mean squared error of held-out folds for each lambda: the folds' cross products come from one grouped aggregation, and training sets are sums of them."""
    grid = np.logspace(-4, 2, 50) if grid is None else np.asarray(grid)
    d = df.withColumn("__fold", F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(folds)))
    parts = gram(d, y, xs, "__fold")
    err = np.zeros(len(grid))
    n = sum(p["n"] for p in parts.values())
    for k, test in parts.items():
        train = {"n": n - test["n"], "s": sum(p["s"] for i, p in parts.items() if i != k), "full": sum(p["full"] for i, p in parts.items() if i != k), "means": test["means"]}
        xx, xy, _ = _centred(train)
        for i, lam in enumerate(grid):
            b = elastic_net_solve(xx, xy, train["n"], lam, alpha)
            v = np.append(-b, 1.0)
            a = train["s"] @ v / train["n"]
            err[i] += v @ test["full"] @ v - 2 * a * (test["s"] @ v) + test["n"] * a * a
    best = int(np.argmin(err))
    return {"lambda": float(grid[best]), "mse": (err / n).tolist(), "grid": grid.tolist()}
