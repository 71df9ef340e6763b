"""Distributions and unit-root statistics on numpy; the constants are published response surfaces and tables."""

from __future__ import annotations

import math

import numpy as np

# MacKinnon (1994, 2010) response surfaces for the Dickey-Fuller (one series) and Engle-Granger
# (two series) statistics with a constant: (tau*, smallest, largest, small-p polynomial, large-p polynomial).
SURFACE = {
    1: (-1.61, -18.83, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (-2.62, -18.86, 0.92, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}
# KPSS level critical values (Kwiatkowski et al. 1992) and Johansen 95 % values for two series with a
# constant (MacKinnon, Haug and Michelis 1999): trace and largest eigenvalue.
KPSS_TABLE = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
JOHANSEN_TRACE, JOHANSEN_EIGEN = 15.4943, 14.2639


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d, tiny = 1.0, 1.0, 0.0, 1e-300
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + num * d, tiny) if 1 + num * d > 0 else 1 / min(1 + num * d, -tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def unit_root_p(tau: float, n_series: int) -> float:
    star, low, high, small, large = SURFACE[n_series]
    if tau > high:
        return 1.0
    if tau < low:
        return 0.0
    return normal_cdf(sum(c * tau**i for i, c in enumerate(small if tau <= star else large)))


def _fit(design: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    inverse = np.linalg.pinv(design.T @ design)
    b = inverse @ (design.T @ target)
    rss = float(((target - design @ b) ** 2).sum())
    return b, rss, inverse


def adf_tau(s: np.ndarray, constant: bool, max_lag: int | None = None) -> float:
    """t-value of the level; lags by AIC on a common sample, then all rows for the lag chosen."""
    n, d = len(s), np.diff(s)
    most = min(math.ceil(12 * (n / 100) ** 0.25), max(0, n // 2 - 1 - constant)) if max_lag is None else max_lag

    def design(lag: int, skip: int):
        parts = [s[skip:-1], *[d[skip - k : len(d) - k] for k in range(1, lag + 1)]]
        return np.column_stack([*parts, np.ones(len(d) - skip)] if constant else parts), d[skip:]

    best = (math.inf, 0)
    for lag in range(most + 1):
        x, y = design(lag, most)
        rss = _fit(x, y)[1]
        best = min(best, (len(y) * math.log(max(rss, 1e-300) / len(y)) + 2 * x.shape[1], lag))
    x, y = design(best[1], best[1])
    b, rss, inverse = _fit(x, y)
    return float(b[0] / math.sqrt(max(rss / (len(y) - x.shape[1]) * inverse[0, 0], 1e-300)))


def adf(s: np.ndarray) -> tuple[float, float]:
    tau = adf_tau(s, True)
    return tau, unit_root_p(tau, 1)


def engle_granger(y: np.ndarray, x: np.ndarray, max_lag: int | None = None) -> tuple[float, float]:
    """Residuals of y on x and a constant, then their unit-root statistic.  Not symmetric in y and x."""
    design = np.column_stack([x, np.ones(len(x))])
    resid = y - design @ _fit(design, y)[0]
    tau = adf_tau(resid, False, max_lag)
    return tau, unit_root_p(tau, 2)


def kpss(s: np.ndarray) -> tuple[float, float]:
    """Level stationarity; bandwidth by Hobijn et al. (1998); p clipped to the table."""
    n, e = len(s), s - s.mean()
    reach = int(n ** (2 / 9))
    s0, s1 = (e * e).sum() / n, 0.0
    for k in range(1, reach + 1):
        c = 2 * (e[k:] * e[:-k]).sum() / n
        s0, s1 = s0 + c, s1 + k * c
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    long_run = (e * e).sum() / n + sum(2 * (1 - k / (lags + 1)) * (e[k:] * e[:-k]).sum() / n for k in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum() / (n * n * long_run))
    return stat, float(np.interp(stat, [a for a, _ in KPSS_TABLE], [p for _, p in KPSS_TABLE]))


def johansen(y: np.ndarray, x: np.ndarray) -> tuple[float, float, float, bool]:
    """(trace, largest eigenvalue statistic, hedge ratio, both above 95 %): constant, one lagged difference."""
    z = np.column_stack([y, x])
    d = np.diff(z, axis=0)
    now, past, level = d[1:], d[:-1], z[1:-1]

    def clean(v):
        w = np.column_stack([past, np.ones(len(past))])
        return v - w @ np.linalg.lstsq(w, v, rcond=None)[0]

    r0, rk = clean(now), clean(level)
    n = len(r0)
    s00, s0k, skk = r0.T @ r0 / n, r0.T @ rk / n, rk.T @ rk / n
    value, vector = np.linalg.eig(np.linalg.solve(skk, s0k.T) @ np.linalg.solve(s00, s0k))
    by = np.argsort(-value.real)
    value, vector = np.clip(value.real[by], 0, 1 - 1e-12), vector.real[:, by]
    trace, top = float(-n * np.log1p(-value).sum()), float(-n * np.log1p(-value[0]))
    return trace, top, float(-vector[1, 0] / vector[0, 0]), trace > JOHANSEN_TRACE and top > JOHANSEN_EIGEN


def kalman(y: np.ndarray, x: np.ndarray, delta: float = 1e-5, noise: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, beta) per row of y = alpha + beta x with random-walk coefficients; the state's six numbers in plain floats."""
    if noise is None:
        design = np.column_stack([x, np.ones(len(x))])
        noise = max(float(np.var(y - design @ _fit(design, y)[0])), 1e-6)
    a = b = 0.0
    paa, pab, pbb = 1e5, 0.0, 1e5
    out = np.empty((2, len(y)))
    for i, (v, u) in enumerate(zip(y.tolist(), x.tolist(), strict=True)):
        paa, pbb = paa + delta, pbb + delta
        ha, hb = paa + u * pab, pab + u * pbb
        s = ha + u * hb + noise
        ka, kb, miss = ha / s, hb / s, v - a - b * u
        a, b = a + ka * miss, b + kb * miss
        paa, pab, pbb = paa - ka * ha, pab - ka * hb, pbb - kb * hb
        out[:, i] = a, b
    return out[0], out[1]


def capped_weights(base: list[float], cap: float, total: float = 1.0) -> list[float]:
    """Shares of total in proportion to base, none above cap (plans/folded.py has the same as windows).

    In falling order of base, those above the cap at the common rate of the rest come first; running sums tell how many.
    What they leave goes to the others (in equal parts, if those have no base); a rest stays cash.
    """
    p = np.maximum(np.asarray(base, float), 0)
    if not len(p):
        return []
    p = p if p.sum() > 0 else np.ones(len(p))
    order = np.argsort(-p, kind="stable")
    q = p[order]
    left, rest = np.maximum(total - cap * np.arange(len(q)), 0), q[::-1].cumsum()[::-1]
    over = (q > 0) & (left * q >= (cap - 1e-15) * rest)
    first = len(q) if over.all() else int(np.argmin(over))
    sorted_weights = np.minimum(cap, left)
    if first < len(q):
        sorted_weights[first:] = left[first] * q[first:] / rest[first] if q[first] > 0 else min(cap, left[first] / (len(q) - first))
    out = np.empty(len(q))
    out[order] = sorted_weights
    return out.tolist()
