"""Smoothing parameters from cross products alone.

Everything takes G = X'WX, c = X'Wz, zz = z'Wz and n, which one aggregation returns; no row is seen again while the penalty
is chosen.
"""

from __future__ import annotations

import numpy as np


def solve(a: np.ndarray, b: np.ndarray, ridge: float = 1e-10) -> np.ndarray:
    """Symmetric system by Cholesky after scaling to a unit diagonal, with a growing ridge where that fails."""
    s = 1 / np.sqrt(np.maximum(np.abs(np.diag(a)), 1e-300))
    m = a * s[:, None] * s[None]
    b2 = (b.T * s).T
    while ridge < 1e3:
        try:
            low = np.linalg.cholesky(m + ridge * np.eye(len(m)))
            return (np.linalg.solve(low.T, np.linalg.solve(low, b2)).T * s).T
        except np.linalg.LinAlgError:
            ridge = max(ridge * 100, 1e-10)
    return np.linalg.lstsq(a, b, rcond=None)[0]


def stable_cholesky(a: np.ndarray, attempts: int = 8) -> np.ndarray:
    jitter = 0.0
    for k in range(attempts):
        try:
            return np.linalg.cholesky(a + jitter * np.eye(len(a)))
        except np.linalg.LinAlgError:
            jitter = 1e-12 * 100**k * max(float(np.trace(a)) / len(a), 1e-300)
    raise np.linalg.LinAlgError("not positive definite")


def log_det_cholesky(a: np.ndarray) -> float:
    return 2 * float(np.log(np.diag(stable_cholesky(a))).sum())


def log_det_positive_semidefinite(a: np.ndarray, rank: int | None = None) -> float:
    w = np.sort(np.linalg.eigvalsh(a))[::-1]
    rank = int((w > w[0] * 1e-10).sum()) if rank is None else rank
    return float(np.log(w[:rank]).sum())


def effective_df(g: np.ndarray, penalty: np.ndarray) -> float:
    """tr((G + P)^-1 G)"""
    return float(np.trace(solve(g + penalty, g)))


def rss_of(b: np.ndarray, g: np.ndarray, c: np.ndarray, zz: float) -> float:
    return max(float(zz - 2 * b @ c + b @ g @ b), 1e-300)


def criteria(g: np.ndarray, c: np.ndarray, zz: float, n: float, penalty: np.ndarray, sigma2: float | None = None) -> dict[str, float]:
    """GCV, REML (Wood 2011, with the penalty's rank), AIC, BIC and UBRE at a penalty."""
    b = solve(g + penalty, c)
    rss, edf = rss_of(b, g, c, zz), effective_df(g, penalty)
    s2 = rss / max(n - edf, 1.0) if sigma2 is None else sigma2
    rank = int(np.linalg.matrix_rank(penalty)) if penalty.any() else 0
    null = len(g) - rank
    logdet_s = log_det_positive_semidefinite(penalty, rank) if rank else 0.0
    dp = rss + float(b @ penalty @ b)
    reml = 0.5 * ((n - null) * np.log(dp / max(n - null, 1.0)) + log_det_cholesky(g + penalty) - logdet_s)
    return {"GCV": n * rss / max(n - edf, 1e-9) ** 2, "REML": float(reml), "ML": float(reml), "AIC": n * np.log(rss / n) + 2 * edf, "GAIC": n * np.log(rss / n) + 2 * edf, "BIC": n * np.log(rss / n) + np.log(n) * edf, "UBRE": rss / n + 2 * s2 * edf / n - s2, "edf": edf, "rss": rss}


def select_lambda(g: np.ndarray, c: np.ndarray, zz: float, n: float, penalties: list[np.ndarray], method: str = "GCV", start: list[float] | None = None, low: float = -8.0, high: float = 10.0) -> list[float]:
    """Penalty weights that minimise a criterion: a grid on log10, refined, one after the other until they settle."""
    lam = list(start or [1.0] * len(penalties))

    def value(k: int, x: float) -> float:
        total = sum((10**x if j == k else lam[j]) * p for j, p in enumerate(penalties))
        try:
            return criteria(g, c, zz, n, total)[method]
        except np.linalg.LinAlgError:
            return np.inf

    for _ in range(1 if len(penalties) == 1 else 4):
        before = list(lam)
        for k in range(len(penalties)):
            grid = np.linspace(low, high, 19)
            for _ in range(3):
                x = float(grid[int(np.argmin([value(k, v) for v in grid]))])
                step = grid[1] - grid[0]
                grid = np.linspace(x - step, x + step, 9)
            lam[k] = 10**x
        if np.allclose(np.log(before), np.log(lam), atol=0.05):
            break
    return lam


def lambda_for_df(g: np.ndarray, penalty: np.ndarray, df: float, low: float = -10.0, high: float = 12.0) -> float:
    """The weight at which the effective degrees of freedom are df, by bisection on log10."""
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if effective_df(g, 10**mid * penalty) > df else (low, mid)
    return 10 ** ((low + high) / 2)


def laplace_log_marginal(objective, theta: np.ndarray, hessian: np.ndarray) -> float:
    """-objective(theta) + p/2 log 2 pi - 1/2 log det H, at the minimiser theta of a negative log joint density."""
    return float(-objective(theta) + 0.5 * len(theta) * np.log(2 * np.pi) - 0.5 * log_det_cholesky(hessian))
