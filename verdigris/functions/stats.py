"""Distribution functions from their published definitions, on arrays: normal and Student t."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def regularized_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * beta_fraction(a, b, x) / a
    return 1.0 - front * beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return regularized_beta(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t for p > 0.5, by bisection."""
    lo, hi = 0.0, 1.0
    while 1.0 - t_two_sided(hi, df) / 2.0 < p:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if 1.0 - t_two_sided(mid, df) / 2.0 < p else (lo, mid)
    return (lo + hi) / 2.0


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def kendall_exact(discordant: int, n: int) -> float:
    """Two-sided p of Kendall's tau without ties: share of permutations at least as extreme, from inversion counts."""
    counts = np.array([1.0])
    for size in range(2, n + 1):
        counts = np.convolve(counts, np.full(size, 1.0 / size))
    least = min(discordant, n * (n - 1) // 2 - discordant)
    return float(min(1.0, 2.0 * counts[: least + 1].sum()))


def _each(f):
    return lambda *cols: pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*cols, strict=True)], dtype="float64")


def t_p_value(t, df):
    """Column: two-sided p of t; one small aggregate per group goes to Python."""
    return F.pandas_udf(_each(lambda a, b: t_two_sided(a, b) if b > 0 else float("nan")), "double")(t, df)


def t_critical(p: float, df):
    return F.pandas_udf(_each(lambda b: t_quantile(p, b) if b > 0 else float("nan")), "double")(df)


def kendall_p_value(concordant_less, n, n0, xt, yt, x3, y3, x2, y2):
    """Column: exact without ties up to 33 pairs of values, else the tie-corrected normal approximation."""

    def one(s, m, pairs, tx, ty, ax, ay, bx, by):
        m = int(m)
        if tx == 0 and ty == 0 and m <= 33:
            return kendall_exact(round((pairs - s) / 2), m)
        v = m * (m - 1) * (2 * m + 5)
        var = (v - ax - ay) / 18.0 + 2.0 * tx * ty / (m * (m - 1)) + bx * by / (9.0 * m * (m - 1) * (m - 2))
        return math.erfc(abs(s) / math.sqrt(var) / math.sqrt(2.0)) if var > 0 else float("nan")

    return F.pandas_udf(_each(one), "double")(concordant_less, n, n0, xt, yt, x3, y3, x2, y2)
