"""Rounding as Spark's round() does it, for tasks that have arrays."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np


def half_up(v: np.ndarray, digits: int) -> np.ndarray:
    """v rounded to digits, halves away from zero; numbers count as their shortest decimals, as in Spark."""
    scaled = np.abs(v) * 10.0**digits
    whole = np.floor(scaled + 0.5)
    out = np.copysign(whole / 10.0**digits, v)
    step = Decimal(1).scaleb(-digits)
    for k in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[k] = float(Decimal(repr(float(v[k]))).quantize(step, ROUND_HALF_UP))
    return out
