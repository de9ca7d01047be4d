"""Gamma distribution without SciPy: maximum likelihood fit, distribution function, normal quantile."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def fit(x: np.ndarray) -> tuple[float, float]:
    """Shape and scale of positive values (location 0), Newton on the likelihood equation."""
    s = math.log(x.mean()) - float(np.log(x).mean())
    if s <= 1e-12:
        return math.inf, 0.0
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        h = 1e-5 * k
        slope = (digamma(k + h) - digamma(k - h)) / (2 * h)
        new = k - (math.log(k) - digamma(k) - s) / (1 / k - slope)
        new = new if new > 0 else k / 2
        if abs(new - k) < 1e-12 * k:
            break
        k = new
    return k, float(x.mean()) / k


def lower(a: float, x: float) -> float:
    """Regularised incomplete gamma function P(a, x)."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * scale
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - scale * h


def spi(totals: np.ndarray) -> np.ndarray:
    """Standardised index of rolling totals; fewer than 10 totals, or a flat series, give missing values."""
    out = np.full(len(totals), np.nan)
    live = ~np.isnan(totals)
    x = totals[live]
    if len(x) < 10 or (x > 0).sum() < 2:
        return out
    zero = float((x <= 0).mean())
    k, scale = fit(x[x > 0])
    if not math.isfinite(k):
        return out
    quantile = NormalDist().inv_cdf
    p = [zero + (1 - zero) * lower(k, v / scale) if v > 0 else zero for v in x]
    out[live] = [quantile(min(max(v, 1e-6), 1 - 1e-6)) for v in p]
    return out
