"""Tails of distributions: incomplete beta and gamma functions over arrays, at a cost that doesn't grow with
the numbers of rows behind them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

LARGE = 2_000.0  #: beyond this a continued fraction takes too many steps, and the density is summed up instead
STEPS = 400
TINY = 1e-300

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(48)
_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def _stirling(x: np.ndarray) -> np.ndarray:
    """What the logarithm of the gamma function has beyond (x - 1/2) log x - x + log(2 pi) / 2; x above 100."""
    y = 1.0 / (x * x)
    return (1.0 / 12 - y * (1.0 / 360 - y * (1.0 / 1260 - y / 1680))) / x


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Without the loss of digits of three large logarithms of gamma functions."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    small = b < 100
    out = np.empty(np.shape(a))
    out[small] = _log_gamma(a[small]) + _log_gamma(b[small]) - _log_gamma(a[small] + b[small]) if small.any() else 0.0
    p, q = a[~small], b[~small]
    both = p >= 100
    s = p + q
    # gamma(q) / gamma(p + q), and gamma(p) as it is or by the same series
    ratio = (q - 0.5) * -np.log1p(p / q) - p * np.log(s) + p + _stirling(q) - _stirling(s)
    own = np.where(both, (p - 0.5) * np.log(p) - p + 0.5 * math.log(2 * math.pi) + _stirling(np.where(both, p, 100.0)), _log_gamma(np.where(both, 1.0, p)) if len(p) else p)
    out[~small] = ratio + own
    return out


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, evaluated from the front."""
    fix = lambda v: np.where(np.abs(v) < TINY, TINY, v)
    c, d = np.ones_like(x), 1.0 / fix(1.0 - (a + b) * x / (a + 1.0))
    h, open_ = d.copy(), np.ones(len(x), bool)
    for m in range(1, STEPS):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 / fix(1.0 + step * d), fix(1.0 + step / c)
            h = np.where(open_, h * d * c, h)
        open_ &= np.abs(d * c - 1.0) > 1e-16
        if not open_.any():
            break
    return h


def _log_density(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The logarithm of the beta density, as it falls from its value at the mean: no large numbers are subtracted."""
    mean = a / (a + b)
    u = (x - mean) / mean
    v = (mean - x) / (1.0 - mean)
    peak = (a - 1) * np.log(mean) + (b - 1) * np.log1p(-mean) - log_beta(a, b)
    return peak + (a - 1) * np.log1p(u) + (b - 1) * np.log1p(v)


def _summed(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The incomplete beta function as the area below or above x, whichever doesn't hold the mean: the density from
    x to twelve standard deviations beyond, in eight parts of 48 points."""
    mean = a / (a + b)
    sd = np.sqrt(mean * (1 - mean) / (a + b + 1))
    below = x <= mean
    reach = np.maximum(14 * sd, 14 / (a + b))
    end = np.where(below, np.maximum(0.0, np.minimum(x, mean - 0 * sd) - reach), np.minimum(1.0, x + reach))
    edges = x[:, None] + (end - x)[:, None] * np.linspace(0.0, 1.0, 9)[None, :]
    low, high = edges[:, :-1, None], edges[:, 1:, None]
    points = (low + high) / 2 + (high - low) / 2 * _NODES[None, None, :]
    inside = np.clip(points, 1e-300, 1 - 1e-16)
    density = np.exp(_log_density(*(np.broadcast_to(t[:, None, None], points.shape).ravel() for t in (a, b)), inside.ravel())).reshape(points.shape)
    area = np.abs((density * _WEIGHTS * np.abs(high - low) / 2).sum((1, 2)))
    return np.where(below, area, 1.0 - area)


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray, rest: np.ndarray | None = None) -> np.ndarray:
    """The regularised incomplete beta function: how much of a beta variable lies below x. rest is 1 - x, where it
    is known better than from x."""
    rest = 1.0 - np.asarray(x, float) if rest is None else rest
    a, b, x, rest = (np.asarray(t, float).ravel() for t in np.broadcast_arrays(a, b, x, rest))
    out = np.where(rest <= 0, 1.0, 0.0)
    inside = (x > 0) & (rest > 0)
    wide = inside & (np.minimum(a, b) > 50) & (np.maximum(a, b) > LARGE)
    if wide.any():
        out[wide] = _summed(a[wide], b[wide], x[wide])
    near = inside & ~wide
    if near.any():
        p, q, t, r = a[near], b[near], x[near], rest[near]
        more = t > 0.5
        front = np.exp(p * np.where(more, np.log1p(-r), np.log(t)) + q * np.where(more, np.log(r), np.log1p(-np.minimum(t, 0.5))) - log_beta(p, q))
        flip = t > (p + 1) / (p + q + 2)
        value = front * _fraction(np.where(flip, q, p), np.where(flip, p, q), np.where(flip, r, t)) / np.where(flip, q, p)
        out[near] = np.where(flip, 1.0 - value, value)
    return np.clip(out, 0.0, 1.0)


def gamma_beyond(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The upper regularised incomplete gamma function: how much of a gamma variable lies above x."""
    a, x = (np.asarray(t, float).ravel() for t in np.broadcast_arrays(a, x))
    out = np.ones(len(x))
    some = x > 0
    # far from the mean nothing or everything is left, whatever the number of degrees
    sure = some & (np.abs(x - a) > 40 * np.sqrt(a) + 800)
    out[sure] = np.where(x[sure] > a[sure], 0.0, 1.0)
    left = some & ~sure
    if not left.any():
        return out
    a, x = a[left], x[left]
    if (a > LARGE).any():
        big = a > LARGE
        part = np.empty(len(a))
        # a gamma variable is what a beta variable of a far larger second number comes to
        part[~big] = gamma_beyond(a[~big], x[~big])
        part[big] = _gamma_area(a[big], x[big])
        out[left] = part
        return out
    front = np.exp(a * np.log(x) - x - _log_gamma(a))
    series = x < a + 1
    total, term = 1.0 / a, 1.0 / a
    for k in range(1, 40 * STEPS):
        term = term * x / (a + k)
        total = total + np.where(series, term, 0.0)
        if (~series | (term <= total * 1e-17)).all():
            break
    b = x + 1.0 - a
    c, d = np.full(len(x), 1.0 / TINY), 1.0 / np.where(np.abs(b) < TINY, TINY, b)
    h = d.copy()
    for k in range(1, 40 * STEPS):
        step = -k * (k - a)
        b = b + 2.0
        d, c = step * d + b, b + step / c
        d, c = 1.0 / np.where(np.abs(d) < TINY, TINY, d), np.where(np.abs(c) < TINY, TINY, c)
        h = np.where(series, h, h * d * c)
        if (series | (np.abs(d * c - 1.0) < 1e-16)).all():
            break
    out[left] = np.where(series, 1.0 - front * total, front * h)
    return np.clip(out, 0.0, 1.0)


def _gamma_area(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    sd = np.sqrt(a)
    below = x <= a
    end = np.where(below, np.maximum(0.0, x - 14 * sd), x + 14 * sd)
    edges = x[:, None] + (end - x)[:, None] * np.linspace(0.0, 1.0, 9)[None, :]
    low, high = edges[:, :-1, None], edges[:, 1:, None]
    points = (low + high) / 2 + (high - low) / 2 * _NODES[None, None, :]
    u = (np.maximum(points, 1e-300) - a[:, None, None]) / a[:, None, None]
    # relative to the value at the mean: log of x^(a-1) e^-x / gamma(a)
    peak = -0.5 * np.log(2 * math.pi * a) - _stirling(a)
    density = np.exp(peak[:, None, None] + (a[:, None, None] - 1) * np.log1p(u) - a[:, None, None] * u)
    area = np.abs((density * _WEIGHTS * np.abs(high - low) / 2).sum((1, 2)))
    return np.where(below, 1.0 - area, area)


def chi_square_p(x: np.ndarray, dof: np.ndarray) -> np.ndarray:
    return gamma_beyond(np.asarray(dof, float) / 2, np.asarray(x, float) / 2)


def student_p(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """How often a t variable is as far from 0, on either side."""
    t, dof = np.broadcast_arrays(np.asarray(t, float), np.asarray(dof, float))
    return beta_share(dof / 2, np.full(dof.shape, 0.5), dof / (dof + t * t), t * t / (dof + t * t))


def share_bounds(hits: np.ndarray, n: np.ndarray, level: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Clopper and Pearson's interval: quantiles of beta variables, by steps that keep to a bracket and follow the
    density where that stays within it."""
    hits, n = np.asarray(hits, float), np.asarray(n, float)
    return (
        np.where(hits > 0, _beta_at(np.maximum(hits, 1), n - np.maximum(hits, 1) + 1, level / 2), 0.0),
        np.where(hits < n, _beta_at(np.minimum(hits, n - 1) + 1, n - np.minimum(hits, n - 1), 1 - level / 2), 1.0),
    )


def _beta_at(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    low, high = np.zeros(len(a)), np.ones(len(a))
    mean = a / (a + b)
    sd = np.sqrt(mean * (1 - mean) / (a + b + 1))
    x = np.clip(mean + (1.96 if p > 0.5 else -1.96) * sd, 1e-12, 1 - 1e-12)
    for _ in range(100):
        f = beta_share(a, b, x) - p
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        slope = np.exp(_log_density(a, b, x))
        step = x - f / np.where(slope > TINY, slope, 1.0)
        new = np.where((slope > TINY) & (step > low) & (step < high), step, (low + high) / 2)
        if (np.abs(new - x) <= 1e-16 + 4e-16 * x).all():
            break
        x = new
    return new


@F.pandas_udf(DoubleType())
def chi_square_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(chi_square_p(x.to_numpy(float), dof.to_numpy(float)))


@F.pandas_udf(DoubleType())
def student_tail(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(student_p(t.to_numpy(float), dof.to_numpy(float)))


@F.pandas_udf(StructType().add("low", "double").add("high", "double"))
def exact_share(hits: pd.Series, n: pd.Series) -> pd.DataFrame:
    low, high = share_bounds(hits.to_numpy(float), n.to_numpy(float))
    return pd.DataFrame({"low": low, "high": high})
