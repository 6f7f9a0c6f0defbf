"""Small-sample statistics. The UDFs run on report rows, never on raw rows."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from traceaudit.functions.text import as_column

P_FLOOR = 1e-200  # fixed value: smallest reported p-value
LARGEST_LOG = 709.782712893384  # log of the largest double
SMALLEST_LOG = -745.0  # fixed value: exp() below this is reported as zero


def _log_beta_term(x: float, a: float, b: float) -> float:
    """Logarithm of x**a (1 - x)**b / B(a, b).

    Large parameters go through Stirling's series: the logarithms of the gamma
    function are then so large that their difference has no exact digits left.
    """
    if min(a, b) < 30.0:
        return math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)

    def rest(z: float) -> float:
        return 1.0 / (12.0 * z) - 1.0 / (360.0 * z**3) + 1.0 / (1260.0 * z**5) - 1.0 / (1680.0 * z**7)

    gap = x * b - (1.0 - x) * a
    powers = a * math.log1p(gap / a) + b * math.log1p(-gap / b)
    return powers + 0.5 * math.log(a / (a + b) * b / (2.0 * math.pi)) + rest(a + b) - rest(a) - rest(b)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(1.0 - x, b, a)
    tiny = 1e-300
    front = math.exp(_log_beta_term(x, a, b)) / a
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in itertools.count(1):  # ends: the terms' effect falls geometrically after about sqrt(max(a, b)) of them
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            total *= step
        if abs(step - 1.0) < 4e-16:
            break
    return front * total


def upper_bound(successes: int, trials: int, confidence: float = 0.95) -> float:
    """One-sided exact binomial upper bound: the rate p with P(X <= k | p) = 1 - confidence."""
    if trials <= 0 or not 0 <= successes <= trials:
        raise ValueError("need 0 <= successes <= trials and trials > 0")
    if not 0.0 < confidence < 1.0:
        raise ValueError("confidence must lie strictly between 0 and 1")
    if successes == trials:
        return 1.0
    low, high = successes / trials, 1.0
    while True:
        middle = 0.5 * (low + high)
        if middle in (low, high):
            return high
        # P(X <= k) is the upper tail of Beta(k + 1, n - k) at the rate.
        if 1.0 - beta_cdf(middle, successes + 1, trials - successes) > 1.0 - confidence:
            low = middle
        else:
            high = middle


def binom_upper(successes: Column | str, trials: Column | str, confidence: float = 0.95) -> Column:
    """Exact upper bound per report row; null where there are no trials."""

    @pandas_udf(T.DoubleType())
    def bound(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([upper_bound(int(a), int(b), confidence) if b and b > 0 else None for a, b in zip(k, n)], dtype="float64")

    return bound(as_column(successes).cast("bigint"), as_column(trials).cast("bigint"))


def green_z(green: Column | str, total: Column | str, gamma: float) -> Column:
    """z-score of a green-token count; 0 when nothing was scored."""
    green, total = as_column(green), as_column(total)
    return F.when(total > 0, (green - gamma * total) / F.sqrt(total * gamma * (1.0 - gamma))).otherwise(0.0)


@pandas_udf(T.DoubleType())
def _normal_tail(z: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or np.isnan(v) else 0.5 * math.erfc(v / math.sqrt(2.0)) for v in z], dtype="float64")


def z_tail(z: Column | str) -> Column:
    """One-sided normal tail probability."""
    return _normal_tail(as_column(z).cast("double"))


def green_p_normal(green: Column | str, total: Column | str, gamma: float) -> Column:
    """Normal-approximation p-value with the reporting floor; 1 without tokens."""
    total = as_column(total)
    return F.when(total > 0, F.greatest(z_tail(green_z(green, total, gamma)), F.lit(P_FLOOR))).otherwise(1.0)


def green_p_exact(green: Column | str, total: Column | str, gamma: float) -> Column:
    """Exact binomial tail P(X >= k) with the reporting floor; 1 without tokens."""

    @pandas_udf(T.DoubleType())
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([1.0 if b <= 0 or a <= 0 else max(beta_cdf(gamma, a, 1 + b - a), P_FLOOR) for a, b in zip(k, n)], dtype="float64")

    return tail(as_column(green).cast("double"), as_column(total).cast("double"))


def hoeffding(mean: Column | str, gamma: float, n: Column | str) -> Column:
    """Conservative tail bound exp(-2 n excess^2) with its logs."""
    excess = F.greatest(as_column(mean).cast("double") - F.lit(float(gamma)), F.lit(0.0))
    log_p = F.lit(-2.0) * as_column(n) * excess * excess
    return F.struct(
        F.when(log_p > SMALLEST_LOG, F.exp(log_p)).otherwise(0.0).alias("p_value"),
        log_p.alias("log_p_value"),
        F.when(excess > 0, -log_p / math.log(10.0)).otherwise(0.0).alias("neg_log10_p"),
    )


def safe_exp(x: Column | str) -> Column:
    """exp() that is null instead of infinite."""
    x = as_column(x)
    return F.when(x <= LARGEST_LOG, F.exp(x))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null for an empty whole."""
    return F.when(whole > 0, part / whole)


def ratio_or_zero(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def mul_known(left: Column | str, right: Column | str, scale: float = 1.0) -> Column:
    """Product that stays unknown (null) when a factor is unknown."""
    return as_column(left) * as_column(right) / F.lit(scale)


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(as_column(x), F.lit(low)), F.lit(high))


def seconds_to_hours(seconds: Column | str, digits: int = 6) -> Column:
    """Hours from seconds already rounded to milliseconds."""
    return F.round(F.round(as_column(seconds), 3) / 3600.0, digits)


def sequence_score(log_probs: Column | str, mask: Column | str) -> Column:
    """Sum, mean, exp(mean) and token count of the unmasked log-probabilities."""
    kept = F.filter(
        F.arrays_zip(as_column(log_probs).alias("lp"), as_column(mask).alias("keep")), lambda z: z["keep"].cast("boolean")
    )
    total = F.aggregate(kept, F.lit(0.0), lambda acc, z: acc + z["lp"])
    count = F.size(kept)
    mean = F.when(count > 0, total / count)
    return F.struct(
        F.when(count > 0, total).alias("sum_log_prob"),
        mean.alias("mean_log_prob"),
        F.exp(mean).alias("geometric_mean_prob"),
        count.cast("bigint").alias("scored_tokens"),
    )
