"""Bins, curves and closeness measures of the inference methods, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def binned(x: Column, bounds: Sequence[float], inclusive: bool = False) -> Column:
    """The number of the first bound above ``x`` (or not below it, if ``inclusive``), else the number of bounds."""
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(x <= bounds[i] if inclusive else x < bounds[i], F.lit(i)).otherwise(out)
    return F.when(x.isNotNull(), out)


def triad_bin(triads: Column) -> Column:
    return binned(triads, (5, 10, 20, 40))


def city_bin(friends: Column) -> Column:
    return binned(friends, (1, 2, 4, 12), inclusive=True)


def decay_curve(d: Column, a: float, b: float, c: float) -> Column:
    """a (d + b)^-c: how likely a tie is at a distance."""
    return F.lit(a) * F.pow(d + F.lit(b), F.lit(-c))


def power_law(d: Column, alpha: float, beta: float) -> Column:
    """beta d^alpha, with the smallest distance in place of 0."""
    return F.lit(beta) * F.pow(F.when(d <= 0, F.lit(1e-8)).otherwise(d), F.lit(alpha))


def rank_logistic(g: Column, c: Column, alpha: float, beta1: float, beta2: float) -> Column:
    z = F.lit(alpha) + F.lit(beta1) * g + F.lit(beta2) * c
    return F.exp(z) / (1 + F.exp(z))


def quantile_of(d: Column, bounds: Sequence[float]) -> Column:
    """The first quantile whose upper bound exceeds ``d``, else the last one."""
    return F.least(binned(d, bounds), F.lit(max(0, len(bounds) - 1)))


def fit_power_law(x: Sequence[float], y: Sequence[float]) -> tuple[float, float]:
    """(alpha, beta) of y = beta x^alpha by least squares on logarithms; points that are not positive are left out."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    ok = (x > 0) & (y > 0)
    if ok.sum() < 2 or np.ptp(np.log(x[ok])) == 0:
        return -0.55, 0.0045
    alpha, log_beta = np.polyfit(np.log(x[ok]), np.log(y[ok]), 1)
    return float(alpha), float(np.exp(log_beta))


def fit_decay(x: Sequence[float], y: Sequence[float], shifts: Sequence[float] = (0.01, 0.1, 0.5, 1, 2, 5, 10, 20, 50)) -> tuple[float, float, float]:
    """(a, b, c) of y = a (x + b)^-c: the best of the given shifts b, each fitted on logarithms."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    ok = (x >= 0) & (y > 0)
    best = (float("inf"), (0.0, 1.0, 1.0))
    for b in shifts:
        if ok.sum() < 2 or np.ptp(np.log(x[ok] + b)) == 0:
            break
        slope, intercept = np.polyfit(np.log(x[ok] + b), np.log(y[ok]), 1)
        a, c = float(np.exp(intercept)), float(-slope)
        error = float(((a * (x[ok] + b) ** -c - y[ok]) ** 2).sum())
        best = min(best, (error, (a, float(b), c)))
    return best[1]
