"""Tail probabilities for test statistics (H6), without SciPy.

All three are closed forms or fixed quadratures over a whole Arrow batch, so
nothing iterates to convergence and nothing is cut short:

* Student t: with ``z^2 = (v / 2) log(1 + t^2 / v)`` the density becomes a
  smooth Gaussian-like function of ``z`` for every number of degrees of freedom
  ``v``, which one Gauss-Legendre rule integrates to about 1e-13. The
  normalising ratio of gamma functions uses its expansion in ``1 / v`` for large
  ``v``, so no large logarithms cancel and the normal tail is the limit.
* Normal: the same rule at ``v = inf``.
* Chi-square with whole degrees of freedom: a finite sum of positive terms.

They only ever run on aggregated rows: one statistic per group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)
#: exp(-_REACH) is negligible against the tail's first value.
_REACH = 45.0


def _half_step_ratio(x: np.ndarray) -> np.ndarray:
    """Gamma(x + 1/2) / (Gamma(x) sqrt(x)): expansion in 1/x from x = 50, gamma functions below."""
    y = 1.0 / np.maximum(x, 50.0)
    far = 1 + y * (-1 / 8 + y * (1 / 128 + y * (5 / 1024 + y * (-21 / 32768 + y * (-399 / 262144)))))
    out = np.where(x >= 50.0, far, 1.0)
    for i in np.flatnonzero(x < 50.0):
        out[i] = math.exp(math.lgamma(x[i] + 0.5) - math.lgamma(x[i])) / math.sqrt(x[i])
    return out


def t_two_sided(t, dof) -> np.ndarray:
    """P(|T| >= |t|) for Student's t, elementwise; dof may be inf; NaN where undefined."""
    t, v = np.broadcast_arrays(np.abs(np.asarray(t, float)), np.asarray(dof, float))
    out = np.full(t.shape, np.nan)
    ok = ~np.isnan(t) & (v > 0)
    out[ok & np.isinf(t)] = 0.0
    ok &= np.isfinite(t)
    t, v = t[ok], v[ok]
    if not len(t):
        return out
    normal = np.isinf(v)
    v = np.where(normal, 1.0, v)
    z0 = np.where(normal, t / math.sqrt(2), np.sqrt(v / 2 * np.log1p(t * t / v)))
    length = _REACH / (np.sqrt(z0 * z0 + _REACH) + z0)
    z = z0[:, None] + length[:, None] * (_NODES + 1) / 2
    y = 2 * z * z / v[:, None]
    # log of z / u(z), where u = sqrt(v (exp(y) - 1)) is the statistic at z
    log_ratio = np.where(normal[:, None], -0.5 * math.log(2),
                         np.log(z) - 0.5 * (np.log(v)[:, None] + y + np.log(-np.expm1(-y))))
    log_decay = np.where(normal[:, None], -z * z, -z * z * (1 - 1 / v[:, None]))
    area = (2 * np.exp(log_ratio + log_decay)) @ _WEIGHTS * length / 2
    scale = np.where(normal, 1.0, _half_step_ratio(v / 2))
    out[ok] = np.minimum(1.0, 2 * scale / math.sqrt(2 * math.pi) * area)
    return out


def norm_two_sided(z) -> np.ndarray:
    """P(|Z| >= |z|) for a standard normal, elementwise."""
    return t_two_sided(z, np.inf)


def _chi2_tail(x: float, dof: int) -> float:
    """Finite sum: even dof are Poisson terms, odd dof their half-integer twins plus a normal tail."""
    h = x / 2
    if h <= 0:
        return 1.0
    terms = dof // 2
    if dof % 2:
        head, first, shift = math.erfc(math.sqrt(h)), 0.5 * math.log(h) - h - math.log(math.sqrt(math.pi) / 2), 1.5
    else:
        head, first, shift = 0.0, -h, 1.0
    if not terms:
        return head
    logs = first + np.concatenate([[0.0], np.cumsum(math.log(h) - np.log(np.arange(terms - 1) + shift))])
    top = logs.max()
    return min(1.0, head + math.exp(top) * float(np.exp(logs - top).sum()))


def chi2_upper(x, dof) -> np.ndarray:
    """P(X >= x) for chi-square with whole ``dof``, elementwise; NaN where undefined."""
    x, dof = np.broadcast_arrays(np.asarray(x, float), np.asarray(dof, float))
    out = np.full(x.shape, np.nan)
    ok = ~np.isnan(x) & (dof > 0)
    if (dof[ok] % 1 != 0).any():
        raise ValueError("chi-square needs whole degrees of freedom")
    out[ok] = [_chi2_tail(a, int(b)) for a, b in zip(x[ok], dof[ok])]
    return out


@F.pandas_udf(DoubleType())
def _t_p_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float), dof.to_numpy(float)))


@F.pandas_udf(DoubleType())
def _chi2_p_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(chi2_upper(x.to_numpy(float), dof.to_numpy(float)))


@F.pandas_udf(DoubleType())
def _norm_p_udf(z: pd.Series) -> pd.Series:
    return pd.Series(norm_two_sided(z.to_numpy(float)))


def _nan_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def t_pvalue(t: Column, dof: Column) -> Column:
    """Two-sided p of a t statistic; NULL when undefined."""
    return _nan_null(_t_p_udf(t.cast("double"), dof.cast("double")))


def chi2_pvalue(x: Column, dof: Column) -> Column:
    return _nan_null(_chi2_p_udf(x.cast("double"), dof.cast("double")))


def norm_pvalue(z: Column) -> Column:
    """Two-sided p of a standard normal statistic."""
    return _nan_null(_norm_p_udf(z.cast("double")))


def norm_ppf(p: float) -> float:
    """Standard normal quantile: bisection on the complementary error function to the last bit."""
    if not 0.0 < p < 1.0:
        raise ValueError("p must be in (0, 1)")
    lo, hi = -40.0, 40.0
    while True:
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            return mid
        if math.erfc(-mid / math.sqrt(2)) / 2 < p:
            lo = mid
        else:
            hi = mid


#: Values of U up to which the exact distribution is counted (400 MB of doubles); beyond, the normal limit holds.
EXACT_U_VALUES = 50_000_000


def exact_u_tail(n1: int, n2: int, u: float) -> float:
    """P(U >= u) for two untied samples under the null hypothesis, u at or above the middle.

    The number of arrangements with each value of U are the coefficients of a
    Gaussian binomial, built factor by factor: multiplying by 1 - q^(n + i)
    subtracts a shifted copy, dividing by 1 - q^i is a running sum with stride
    i. By symmetry only the coefficients up to n1 * n2 - u are needed.
    """
    m, n = min(n1, n2), max(n1, n2)
    top = math.floor(m * n - u)
    if top < 0:
        return 0.0
    whole = (top + 1) * m <= 200_000
    ways = np.zeros(top + 1, dtype=object if whole else float)
    ways[0] = 1
    for i in range(1, m + 1):
        if n + i <= top:
            ways[n + i:] = ways[n + i:] - ways[:top + 1 - n - i]
        for r in range(min(i, top + 1)):
            ways[r::i] = np.cumsum(ways[r::i])
    total = math.comb(m + n, m)
    return float(sum(ways.tolist())) / total if not whole else sum(ways.tolist()) / total


def exact_u_pvalue(n1: Column, n2: Column, umax: Column) -> Column:
    """Two-sided exact p of the larger U statistic (one row per test)."""
    @F.pandas_udf(DoubleType())
    def p(a: pd.Series, b: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([min(1.0, 2 * exact_u_tail(int(x), int(y), z)) if x == x and z == z and x > 0 and y > 0 else None for x, y, z in zip(a, b, u)], dtype="float64")

    return p(n1, n2, umax)
