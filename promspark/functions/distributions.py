"""Tail probabilities for test statistics (t, chi-square, normal).

Applied as Arrow-batched pandas UDFs to result tables (one row per feature
or pair), never to base rows.  The numerics follow the continued fractions and
series of the regularised incomplete beta and gamma functions in the NIST
Digital Library of Mathematical Functions (DLMF), chapter 8.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

ENOUGH = 1e-16
LARGE_DF = 1e6


def _continued_fraction(terms) -> float:
    """Value of a1/(b1 + a2/(b2 + ...)) for (a, b) pairs, from the front: the ratios of
    successive numerators and denominators are kept instead of both."""
    value, up, down = 0.0, 0.0, 0.0
    for k, (a, b) in enumerate(terms):
        down = 1.0 / ((b + a * down) or 1e-300)
        if k == 0:
            up, value = 1e300, a * down
            continue
        up = (b + a / up) or 1e-300
        step = up * down
        value *= step
        if abs(step - 1.0) < ENOUGH * 4:
            break
    return value


def _stirling_rest(z: float) -> float:
    """ln gamma(z) - ((z - 1/2) ln z - z + ln(2 pi) / 2), for z of 10 and over."""
    w = 1.0 / (z * z)
    return (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w / 1188)))) / z


def log_beta(a: float, b: float) -> float:
    """ln B(a, b); for a large argument the difference of two log-gammas is taken term by term, so that
    their leading digits do not cancel."""
    a, b = max(a, b), min(a, b)
    if a < 10.0:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    # ln gamma(a) - ln gamma(a + b) = -(a - 1/2) ln(1 + b/a) - b ln(a + b) + b + rests
    return math.lgamma(b) - (a - 0.5) * math.log1p(b / a) - b * math.log(a + b) + b + _stirling_rest(a) - _stirling_rest(a + b)


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b), by its continued fraction (DLMF 8.17.22)."""
    return _betainc(a, b, x, 1.0 - x)


def _betainc(a: float, b: float, x: float, y: float) -> float:
    """I_x(a, b) with y = 1 - x given on its own, as x may be near 1."""
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _betainc(b, a, y, x)

    def terms():
        yield 1.0, 1.0
        for m in range(0, 2000):
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
            yield (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2)), 1.0

    log_x = math.log1p(-y) if y < 0.5 else math.log(x)
    log_y = math.log1p(-x) if x < 0.5 else math.log(y)
    return math.exp(a * log_x + b * log_y - log_beta(a, b)) / a * _continued_fraction(terms())


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): the series of P below a + 1 (DLMF 8.11.4), the continued
    fraction of Q above (DLMF 8.9.2)."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while term > ENOUGH * total:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - scale * total

    def terms():
        yield 1.0, x + 1.0 - a
        for k in range(1, 5000):
            yield -k * (k - a), x + 2 * k + 1.0 - a

    return scale * _continued_fraction(terms())


def t_two_sided_p(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom."""
    if t is None or df is None or not np.isfinite(df) or df <= 0 or (isinstance(t, float) and math.isnan(t)):
        return float("nan")
    if math.isinf(t):
        return 0.0
    if df >= LARGE_DF:  # Wallace (1959): the normal deviate of the same tail, to a relative 1 / df**2
        return normal_two_sided_p((8 * df + 1) / (8 * df + 3) * math.sqrt(df * math.log1p(t * t / df)))
    return _betainc(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def chi2_sf(x: float, df: float) -> float:
    """P(X >= x) for chi-square with ``df`` degrees of freedom."""
    if x is None or df is None or df <= 0 or (isinstance(x, float) and math.isnan(x)):
        return float("nan")
    return gammainc_upper(df / 2.0, x / 2.0)


def normal_two_sided_p(z: float) -> float:
    if z is None or (isinstance(z, float) and math.isnan(z)):
        return float("nan")
    return math.erfc(abs(z) / math.sqrt(2.0))


@pandas_udf(DoubleType())
def _t_p_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None
                      for a, b in zip(t, df)], dtype="float64")


@pandas_udf(DoubleType())
def _chi2_p_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None
                      for a, b in zip(x, df)], dtype="float64")


@pandas_udf(DoubleType())
def _z_p_udf(z: pd.Series) -> pd.Series:
    return pd.Series([normal_two_sided_p(float(a)) if pd.notna(a) else None for a in z], dtype="float64")


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic (result tables only)."""
    return _t_p_udf(t.cast("double"), df.cast("double"))


def chi2_p_value(x: Column, df: Column) -> Column:
    return _chi2_p_udf(x.cast("double"), df.cast("double"))


def z_p_value(z: Column) -> Column:
    return _z_p_udf(z.cast("double"))


def corr_t(r: Column, n: Column) -> Column:
    """t = r * sqrt((n - 2) / (1 - r^2)); df = n - 2."""
    return r * F.sqrt((n - 2) / F.greatest(F.lit(1e-300), 1 - r * r))
