"""Least-squares fits of one series, run inside grouped pandas functions."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np

GRID_ORDERS = tuple((p, d, q) for p in range(3) for d in range(2) for q in range(3))


def _lagged(values: np.ndarray, count: int, start: int) -> np.ndarray:
    """Columns values[t-1] … values[t-count] for t from ``start``."""
    n = len(values)
    return np.column_stack([values[start - k : n - k] for k in range(1, count + 1)]) if count else (
        np.empty((n - start, 0))
    )


def _solve(design: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not design.shape[1]:
        return np.empty(0), target
    coef, *_ = np.linalg.lstsq(design, target, rcond=None)
    return coef, target - design @ coef


def _innovations(w: np.ndarray, order: int) -> np.ndarray:
    """Residuals of a long autoregression, zero before it starts (Hannan and Rissanen, step 1)."""
    design = np.column_stack([np.ones(len(w) - order), _lagged(w, order, order)])
    _, residual = _solve(design, w[order:])
    return np.concatenate([np.zeros(order), residual])


def _long_order(n: int, p: int, q: int) -> int:
    """Length of the autoregression whose residuals stand for the innovations."""
    return min(max(p + q + 1, int(np.ceil(np.log(max(n, 2)) ** 1.5))), n // 3)


def _first_row(n: int, p: int, q: int) -> int:
    """The first value that an order can explain."""
    return max(p, _long_order(n, p, q) + q if q else 0)


def _inside(coef: np.ndarray) -> bool:
    """Do the roots of z^k - c1 z^(k-1) - ... lie inside the unit circle?"""
    return not len(coef) or bool(np.abs(np.roots(np.concatenate([[1.0], -coef]))).max() < 0.999)


def _fit_arma(w: np.ndarray, p: int, q: int, constant: bool, first: int) -> dict | None:
    """Regression of w from place ``first`` on its own lags and lagged innovations. None if there
    are too few rows or if the result is not stable and invertible."""
    n = len(w)
    noise = np.zeros(n)
    if q:
        if (long := _long_order(n, p, q)) < 1:
            return None
        noise = _innovations(w, long)
    parts = [np.ones((n - first, 1))] if constant else []
    design = np.column_stack([*parts, _lagged(w, p, first), _lagged(noise, q, first)])
    if design.shape[0] <= design.shape[1] + 1:
        return None
    coef, residual = _solve(design, w[first:])
    lags = coef[constant:]
    if not _inside(lags[:p]) or not _inside(-lags[p:]):
        return None
    sigma2 = float(residual @ residual) / len(residual)
    k = p + q + 1 + constant
    aic = len(residual) * (np.log(2 * np.pi * max(sigma2, 1e-12)) + 1) + 2 * k
    return {
        "const": coef[0] if constant else 0.0,
        "ar": lags[:p],
        "ma": lags[p:],
        "sigma2": sigma2,
        "noise": residual[len(residual) - q :] if q else np.empty(0),
        "aic": aic,
    }


def dickey_fuller(w: np.ndarray) -> float:
    """t statistic of the level in a regression of the change on a constant and the level."""
    change, level = np.diff(w), w[:-1]
    centred = level - level.mean()
    sxx = float(centred @ centred)
    if len(w) < 4 or sxx <= 0:
        return 0.0
    slope = float(centred @ change) / sxx
    residual = change - change.mean() - slope * centred
    error = np.sqrt(float(residual @ residual) / (len(change) - 2) / sxx)
    return slope / error if error > 0 else 0.0


def _choose_d(y: np.ndarray) -> int:
    for d in range(3):
        w = np.diff(y, d)
        if len(w) >= 20 and dickey_fuller(w) < -2.86:
            return d
    return 1


def _orders(y: np.ndarray, search: str) -> list[tuple[int, int, int]]:
    if search == "grid":
        return list(GRID_ORDERS)
    d = _choose_d(y)
    return [(p, d, q) for p in range(4) for q in range(4) if p or q]


def _psi(ar: np.ndarray, ma: np.ndarray, d: int, steps: int) -> np.ndarray:
    """Weights of past shocks in the integrated process."""
    phi = np.concatenate([[1.0], -ar])
    for _ in range(d):
        phi = np.convolve(phi, [1.0, -1.0])
    psi = np.zeros(steps)
    for j in range(steps):
        psi[j] = 1.0 if j == 0 else (ma[j - 1] if j <= len(ma) else 0.0)
        for i in range(1, min(j, len(phi) - 1) + 1):
            psi[j] -= phi[i] * psi[j - i]
    return psi


def _project(w: np.ndarray, model: dict, steps: int) -> np.ndarray:
    """Iterated point forecasts of the differenced series; future shocks are zero."""
    values, shocks = list(w), list(model["noise"])
    p, q = len(model["ar"]), len(model["ma"])
    for _ in range(steps):
        ar = sum(model["ar"][i] * values[-1 - i] for i in range(p))
        ma = sum(model["ma"][i] * shocks[-1 - i] for i in range(q))
        values.append(model["const"] + ar + ma)
        shocks.append(0.0)
    return np.array(values[len(w) :])


def fit_arima(
    y: np.ndarray, steps: int, search: str = "grid", alpha: float = 0.05, orders=None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best order by AIC; point forecasts and an interval from the shock weights. Only undifferenced
    series have a constant. All orders are fitted on the same values, those that each of them can
    explain, so that their AIC can be compared; the mean stands in where none can be fitted."""
    best, best_order = None, (0, 0, 0)
    tried = list(orders) if orders is not None else _orders(y, search)
    tried = [(p, d, q) for p, d, q in tried if len(y) - d > p + q + 3]
    start = max((d + _first_row(len(y) - d, p, q) for p, d, q in tried), default=0)
    for p, d, q in tried:
        w = np.diff(y, d)
        model = _fit_arma(w, p, q, d == 0, start - d)
        if model is not None and np.isfinite(model["aic"]):
            if best is None or model["aic"] < best["aic"]:
                best, best_order = model, (p, d, q)
    if best is None:
        level, std = float(y.mean()), float(y.std(ddof=1))
        flat = np.full(steps, level)
        return flat, flat - std, flat + std
    d = best_order[1]
    point = _project(np.diff(y, d), best, steps)
    for k in range(d, 0, -1):
        point = np.cumsum(point) + np.diff(y, k - 1)[-1]
    psi = _psi(best["ar"], best["ma"], d, steps)
    std = np.sqrt(best["sigma2"] * np.cumsum(psi**2))
    reach = NormalDist().inv_cdf(1 - alpha / 2) * std
    return point, point - reach, point + reach


def fit_autoregressive(
    y: np.ndarray, steps: int, n: int, ridge: float
) -> tuple[np.ndarray, float]:
    """Ridge regression on the last ``n`` scaled values, rolled forward; residual deviation."""
    low, high = float(y.min()), float(y.max())
    span = high - low or 1.0
    scaled = (y - low) / span
    design = np.column_stack([np.ones(len(y) - n), _lagged(scaled, n, n)])
    penalty = ridge * np.eye(n + 1)
    penalty[0, 0] = 0.0
    coef = np.linalg.solve(design.T @ design + penalty + 1e-9 * np.eye(n + 1),
                           design.T @ scaled[n:])
    residual = scaled[n:] - design @ coef
    values = list(scaled)
    for _ in range(steps):
        values.append(coef[0] + float(coef[1:] @ np.array(values[-1 : -n - 1 : -1])))
    point = np.array(values[len(y) :]) * span + low
    return point, float(residual.std(ddof=1)) * span
