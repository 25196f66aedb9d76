"""Column expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CFS_TO_CMS = 0.028316846592  # fixed value: cubic feet to cubic metres
SECONDS_PER_DAY = 86400.0
FIVE_THIRDS = 5.0 / 3.0


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def as_double(x: Column) -> Column:
    """Cast that turns unreadable text, NaN and infinities into null."""
    return finite(x.try_cast("double"))


def norm_gauge(x: Column, width: int = 0) -> Column:
    """Gauge id as text: trimmed, trailing ``.0`` of float ids removed, zero padded."""
    text = F.regexp_replace(F.trim(x.cast("string")), r"\.0+$", "")
    if not width:
        return text
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def blank_to_null(x: Column) -> Column:
    text = F.trim(x)
    return F.when(text != "", text)


def energy_joule(magnitude: Column) -> Column:
    """Radiated energy 10^(5.24 + 1.44 M)."""
    return F.pow(F.lit(10.0), F.lit(5.24) + F.lit(1.44) * magnitude)


def de_number(frequency: Column, tau: Column) -> Column:
    """Memory-normalised frequency; null unless tau is positive."""
    return F.when(tau > 0, frequency * tau)


def safe_log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, null when ``den`` is 0 or null."""
    return F.when(den != 0, num / den)


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation, null when either side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs = F.when(both, F.col(x).cast("double"))
    ys = F.when(both, F.col(y).cast("double"))
    spread = F.stddev_pop(xs) * F.stddev_pop(ys)
    return F.covar_pop(xs, ys) / F.nullif(spread, F.lit(0.0))


def beta_status(beta: Column, n: Column, tolerance: float) -> Column:
    """near / below / above the 5/3 slope, ``no_test`` without usable evidence."""
    usable = (n > 0) & finite(beta).isNotNull()
    return (
        F.when(~F.coalesce(usable, F.lit(False)), "no_test")
        .when(F.abs(beta - F.lit(FIVE_THIRDS)) <= F.lit(tolerance), "near_5_3")
        .when(beta < F.lit(FIVE_THIRDS), "below_5_3")
        .otherwise("above_5_3")
    )
