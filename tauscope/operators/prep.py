"""Time-series preparation: calendars, gaps, seasons, trends, scales, coverage.

Every function takes the series key columns, so one plan serves any number of series.
Raw records are first reduced to calendar bins by a partial (map-side) aggregation;
windows keyed by series therefore only ever see one row per calendar bin, whatever
share of the raw rows the series holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tauscope.functions.expressions import finite

DOUBLES = T.ArrayType(T.DoubleType())
RULES = {"D": "day", "H": "hour", "MS": "month", "W": "week", "YS": "year"}


def bin_start(time: str | Column, rule: str) -> Column:
    """Calendar bin label; weeks are labelled by the Sunday that closes them."""
    if rule not in RULES:
        raise ValueError(f"unsupported rule: {rule}")
    time = F.col(time) if isinstance(time, str) else time
    start = F.date_trunc(RULES[rule], time).cast("timestamp_ntz")
    return start + F.expr("interval 6 days") if rule == "W" else start


def _bin_step(rule: str) -> Column:
    step = {"D": "1 day", "H": "1 hour", "MS": "1 month", "W": "7 days", "YS": "1 year"}[rule]
    return F.expr(f"interval {step}")


def calendar(df: DataFrame, keys: Sequence[str], time: str, step: Column) -> DataFrame:
    """Every calendar stamp between the first and last stamp of each series."""
    span = df.groupBy(*keys).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    return span.select(*keys, F.explode(F.sequence("_lo", "_hi", step)).alias(time))


def resample(
    df: DataFrame, keys: Sequence[str], time: str, value: Column, rule: str, how: str = "mean"
) -> DataFrame:
    """Calendar bins with ``mean`` (empty bins null), or ``sum``/``count`` (empty bins 0)."""
    measure = {"mean": F.avg("_v"), "sum": F.sum("_v"), "count": F.count(F.lit(1))}[how]
    binned = (
        df.where(F.col(time).isNotNull())
        .select(*keys, bin_start(time, rule).alias("time"), value.alias("_v"))
        .groupBy(*keys, "time")
        .agg(measure.cast("double").alias("value"))
    )
    grid = calendar(binned, keys, "time", _bin_step(rule))
    out = grid.join(binned, [*keys, "time"], "left")
    return out if how == "mean" else out.withColumn("value", F.coalesce("value", F.lit(0.0)))


def event_rate(df: DataFrame, keys: Sequence[str], time: str, rule: str) -> DataFrame:
    return resample(df, keys, time, F.lit(1.0), rule, "count")


def regular_grid(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Daily grid between the first and last row of each series; absent days are null.

    A row is followed by the days up to the next one, so only given rows are shuffled, and the
    grid lies where its series is: windows keyed by series need no further shuffle.
    """
    step = F.expr("interval 1 day")
    ahead = F.lead(day).over(W.partitionBy(*keys).orderBy(day))
    rows = df.where(F.col(day).isNotNull()).withColumn("_ahead", ahead)
    grid = rows.withColumn("_stamp", F.explode(F.sequence(F.col(day), F.greatest(F.col(day), F.col("_ahead") - step), step)))
    own = F.col("_stamp") == F.col(day)
    values = [F.when(own, F.col(c)).alias(c) for c in df.columns if c not in (*keys, day)]
    return grid.select(*keys, F.col("_stamp").alias(day), *values)


def zero_filled(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Daily grid where an absent day means nothing happened."""
    return regular_grid(df, keys, day).withColumn(value, F.coalesce(value, F.lit(0.0)))


def season_key(day: str, unit: str) -> Column:
    """Calendar class of a stamp; ``D`` day of year, ``W`` ISO week, ``M`` month."""
    return {"D": F.dayofyear, "W": F.weekofyear, "M": F.month}[unit](day)


def deseason(
    df: DataFrame, keys: Sequence[str], day: str, value: str, stat: str = "median", unit: str = "D"
) -> DataFrame:
    """Subtract the per-series climatology and keep it as ``seasonal_cycle``."""
    season = W.partitionBy(*keys, season_key(day, unit))
    level = {"median": F.median, "mean": F.avg}[stat](value).over(season)
    return df.withColumn("seasonal_cycle", level).withColumn(
        value, F.col(value) - F.col("seasonal_cycle")
    )


def from_end(keys: Sequence[str], time: str):
    """Frame of a row and all later ones, in falling order: a frame that only grows is not computed anew for every row."""
    return W.partitionBy(*keys).orderBy(F.col(time).desc()).rowsBetween(W.unboundedPreceding, 0)


def gap_fill_linear(
    df: DataFrame, keys: Sequence[str], time: str, value: str, limit: int, both: bool = False
) -> DataFrame:
    """Fill at most ``limit`` nulls per gap on a regular grid by straight lines.

    Forward mode fills the first ``limit`` rows after a valid value (series tails repeat
    the last value). ``both`` also fills ``limit`` rows before the next valid value and
    pads the head. Longer gaps stay partly null.
    """
    order = W.partitionBy(*keys).orderBy(time)
    past = order.rowsBetween(W.unboundedPreceding, 0)
    ahead = from_end(keys, time)
    known = F.col(value).isNotNull()
    out = df.withColumn("_i", F.row_number().over(order)).select(
        "*",
        F.last(F.when(known, F.col("_i")), True).over(past).alias("_pi"),
        F.last(value, True).over(past).alias("_pv"),
        F.last(F.when(known, F.col("_i")), True).over(ahead).alias("_ni"),
        F.last(value, True).over(ahead).alias("_nv"),
    )
    from_left = F.col("_i") - F.col("_pi")
    from_right = F.col("_ni") - F.col("_i")
    line = F.when(
        F.col("_pi").isNotNull() & F.col("_ni").isNotNull(),
        F.col("_pv") + (F.col("_nv") - F.col("_pv")) * from_left / F.nullif(F.col("_ni") - F.col("_pi"), F.lit(0)),
    ).otherwise(F.col("_pv"))
    reach = from_left <= limit
    if both:
        reach = F.coalesce(reach, F.lit(False)) | F.coalesce(from_right <= limit, F.lit(False))
        line = F.coalesce(line, F.col("_nv"))
    filled = F.when(known, F.col(value)).when(reach, line)
    return out.withColumn(value, filled).drop("_i", "_pi", "_pv", "_ni", "_nv")


def fill_then(df: DataFrame, keys: Sequence[str], time: str, value: str, limit: int, rest: str) -> DataFrame:
    """Forward fill as above, then the rest with ``zero`` or the nearest value (``edge``)."""
    out = gap_fill_linear(df, keys, time, value, limit)
    if rest == "zero":
        return out.withColumn(value, F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)))
    order = W.partitionBy(*keys).orderBy(time)
    back = F.last(value, True).over(from_end(keys, time))
    forward = F.last(value, True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn(value, F.coalesce(F.col(value), back, forward))


def detrend_linear(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Subtract the least-squares line in time; fewer than two values stay unchanged."""
    series = W.partitionBy(*keys)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / F.lit(1e6)
    v = F.col(value)
    work = df.withColumn("_t", seconds).withColumn(
        "_t", F.col("_t") - F.avg(F.when(v.isNotNull(), F.col("_t"))).over(series)
    )
    t = F.when(v.isNotNull(), F.col("_t"))
    slope = F.sum(t * v).over(series) / F.nullif(F.sum(t * t).over(series), F.lit(0.0))
    trend = F.coalesce(slope * F.col("_t"), F.lit(0.0)) + F.avg(v).over(series)
    many = F.count(v).over(series) >= 2
    return work.withColumn(value, F.when(many, v - trend).otherwise(v)).drop("_t")


def scaled(
    df: DataFrame, keys: Sequence[str], value: str, factor: float = 1.4826, fallback: str = "pop",
    center: str = "median",
) -> DataFrame:
    """(x - centre) / (factor * MAD) with a fallback when the MAD is 0.

    ``pop``/``sample``: use that standard deviation, and 0 if it is 0 too.
    ``unscaled``: leave the values as they are (no centring either).
    """
    series = W.partitionBy(*keys)
    v = finite(F.col(value))
    work = df.withColumn("_x", v)
    work = work.withColumn("_med", F.median("_x").over(series))
    mad = F.median(F.abs(F.col("_x") - F.col("_med"))).over(series)
    scale = F.nullif(F.lit(factor) * mad, F.lit(0.0))
    if fallback == "unscaled":
        done = F.coalesce((F.col("_x") - F.col("_med")) / scale, F.col("_x"))
    else:
        std = F.stddev_pop("_x") if fallback == "pop" else F.stddev_samp("_x")
        scale = F.coalesce(scale, F.nullif(std.over(series), F.lit(0.0)))
        done = F.when(F.col("_x").isNotNull(), F.coalesce((F.col("_x") - F.col("_med")) / scale, F.lit(0.0)))
    return work.withColumn(value, done).drop("_x", "_med")


def robust_z(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return scaled(df, keys, value)


def velocity_anomaly(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return scaled(df, keys, value, fallback="sample")


def mad_plain(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return scaled(df, keys, value, factor=1.0, fallback="unscaled")


def anomaly_season_first(df: DataFrame, keys: Sequence[str], day: str, value: str, limit: int = 30) -> DataFrame:
    """Climatology on recorded rows, then grid, forward fill, drop, plain MAD."""
    work = deseason(df, keys, day, value, "mean").drop("seasonal_cycle")
    work = gap_fill_linear(regular_grid(work, keys, day), keys, day, value, limit)
    return mad_plain(work.where(F.col(value).isNotNull()), keys, value)


def anomaly_fill_first(
    df: DataFrame, keys: Sequence[str], day: str, value: str, limit: int = 30, both: bool = True
) -> DataFrame:
    """Grid, fill, drop, then climatology and plain MAD."""
    work = gap_fill_linear(regular_grid(df, keys, day), keys, day, value, limit, both)
    work = deseason(work.where(F.col(value).isNotNull()), keys, day, value, "mean")
    return mad_plain(work.drop("seasonal_cycle"), keys, value)


def once(helper):
    """A helper whose result several columns or a filter read: marked so, a plan does not repeat it for each of them."""
    return helper.asNondeterministic()


def filled_days(at: np.ndarray, given: np.ndarray) -> np.ndarray:
    """The value of every day from the first to the last, 0 where none is given."""
    row = np.zeros(at.max() - at.min() + 1)
    row[at - at.min()] = given
    return row


@F.pandas_udf(DOUBLES)
def filled(days: pd.Series, values: pd.Series) -> pd.Series:
    """Vectorised helper: :func:`filled_days` of every series."""
    return pd.Series([filled_days(at, given) for at, given in zip(days, values)], dtype=object)


def per_series(work: Callable[..., list]):
    """Vectorised helper: ``work(first day, daily values, *further columns)`` of every series of recorded days, a list of short arrays each.

    Filling, drawing and measuring a series happen in one worker, so no series is handed from one to the next and batches hold little besides results.
    """

    @F.pandas_udf(T.ArrayType(DOUBLES))
    def helper(days: pd.Series, values: pd.Series, *more: pd.Series) -> pd.Series:
        return pd.Series([work(int(at.min()), filled_days(at, given), *rest) for at, given, *rest in zip(days, values, *more)], dtype=object)

    return once(helper)


def n_days(rows: str = "_rows") -> Column:
    """Days from the first to the last of packed recorded days."""
    return F.array_max(f"{rows}.d") - F.array_min(f"{rows}.d") + 1


def daily_series(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """One row per series: its first day (since 1970) and the values of all days up to its last, absent ones 0.

    One value per calendar day keeps a series at some thousand numbers, whatever the number of raw rows, and what follows needs no shuffle.
    """
    return filled_series(recorded_days(df, keys, day, value), keys)


def recorded_days(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """One row per series: its recorded days and their values, packed by the only shuffle of :func:`daily_series`."""
    rows = F.collect_list(F.struct(F.unix_date(day).alias("d"), F.coalesce(F.col(value), F.lit(0.0)).alias("v")))
    return df.where(F.col(day).isNotNull()).groupBy(*keys).agg(rows.alias("_rows"))


def filled_series(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`daily_series` of the rows of :func:`recorded_days`."""
    return packed.select(*keys, F.array_min("_rows.d").alias("first"), once(filled)("_rows.d", "_rows.v").alias("xs"))


def packed_halves(series: DataFrame) -> DataFrame:
    """:func:`split_half` of packed daily series: ``parts`` holds (segment, first, xs) of both halves."""
    return _packed_parts(series, ["first", "second"], lambda n: [F.lit(0), F.expr("(size(xs) + 1) div 2")])


def packed_blocks(series: DataFrame, k: int) -> DataFrame:
    """:func:`split_blocks` of packed daily series: ``parts`` holds (segment, first, xs) of the blocks 0..k-1."""
    return _packed_parts(series, range(k), lambda n: [F.ceil(F.lit(b) * (n - 1) / F.lit(k)) for b in range(k)])


def _packed_parts(series: DataFrame, names: Sequence, starts) -> DataFrame:
    at = [c.cast("int") for c in starts(F.size("xs"))]
    parts = [
        F.struct(F.lit(name).alias("segment"), (F.col("first") + a).alias("first"), F.slice("xs", a + 1, b - a).alias("xs"))
        for name, a, b in zip(names, at, [*at[1:], F.size("xs")])
    ]
    return series.withColumn("parts", F.array(*parts)).drop("first", "xs")


def anomaly_of(start: int, x: np.ndarray) -> np.ndarray:
    """Daily values less the mean of their day of the year, then as in :func:`mad_plain`."""
    day = (start + np.arange(len(x))).astype("M8[D]")
    season = (day - day.astype("M8[Y]").astype("M8[D]")).astype(int)
    x = x - (np.bincount(season, x) / np.maximum(np.bincount(season), 1))[season]
    centred = x - np.median(x)
    mad = np.median(np.abs(centred))
    return centred / mad if mad > 0 else x


@F.pandas_udf(DOUBLES)
def plain_anomaly(first: pd.Series, values: pd.Series) -> pd.Series:
    """Vectorised helper: :func:`anomaly_of` every series."""
    return pd.Series([anomaly_of(start, x) for start, x in zip(first, values)], dtype=object)


def standardize(df: DataFrame, time: str, value: str, **metadata) -> DataFrame:
    """Tidy form: time, value and one constant column per metadata item."""
    tags = [F.lit(v).alias(k) for k, v in metadata.items()]
    return df.select(F.col(time).alias("time"), F.col(value).cast("double").alias("value"), *tags)


def trim_valid(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Cut a series to the stretch between its first and last non-null value."""
    series = W.partitionBy(*keys)
    seen = F.when(F.col(value).isNotNull(), F.col(time))
    return (
        df.withColumn("_lo", F.min(seen).over(series))
        .withColumn("_hi", F.max(seen).over(series))
        .where(F.col(time).between(F.col("_lo"), F.col("_hi")))
        .drop("_lo", "_hi")
    )


def coverage_station(df: DataFrame, key: str, day: str, names: Sequence[str]) -> DataFrame:
    """Span, distinct days and missing share per station."""
    days = F.datediff(F.max(day), F.min(day))
    firsts = [F.min_by(n, F.when(F.col(n).isNotNull(), F.col(day))).alias(n) for n in names]
    return (
        df.groupBy(key)
        .agg(
            *firsts,
            F.min(day).alias("start"),
            F.max(day).alias("end"),
            F.count_distinct(day).alias("n_days"),
            (days / F.lit(365.25)).alias("years"),
            (days + 1).alias("_expected"),
        )
        .withColumn("missing_fraction", F.lit(1.0) - F.col("n_days") / F.col("_expected"))
        .drop("_expected")
    )


def coverage_glacier(df: DataFrame, keys: Sequence[str], day: str, value: str, error: str) -> DataFrame:
    days = F.datediff(F.max(day), F.min(day))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min(day).alias("start"),
        F.max(day).alias("end"),
        (days / F.lit(365.25)).alias("years"),
        F.median(value).alias("median_velocity"),
        F.median(error).alias("median_error"),
    )


def coverage_segment(df: DataFrame, keys: Sequence[str], day: str, value: str, extra_day: int = 1) -> DataFrame:
    """Years by span, missing, null and zero-flow shares, clipped at 0."""
    expected = F.datediff(F.max(day), F.min(day)) + extra_day
    rows = F.count(F.lit(1))
    known = F.count(value)
    return df.groupBy(*keys).agg(
        (expected / F.lit(365.25)).alias("n_years"),
        F.greatest(F.lit(0.0), F.lit(1.0) - known / F.nullif(expected, F.lit(0))).alias("missing_fraction"),
        (F.lit(1.0) - known / rows).alias("null_fraction"),
        (F.sum(F.when(F.col(value) == 0, 1).otherwise(0)) / F.nullif(known, F.lit(0))).alias("zero_fraction"),
    )


def coverage_reason(df: DataFrame, min_years: float, max_missing: float) -> DataFrame:
    """Why a gauge is turned away before any spectrum is computed; ``included`` if not."""
    reason = (
        F.when(F.col("n_years").isNull(), "no_nonnegative_discharge")
        .when((F.col("n_years") < min_years) | (F.col("missing_fraction") > max_missing), "coverage_filter")
        .otherwise("included")
    )
    return df.withColumn("reason", reason)


def split_half(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """``first`` up to the midpoint in time (inclusive), ``second`` after it."""
    return _with_span(df, keys, time).withColumn(
        "segment",
        F.when(F.col("_t") * 2 <= F.col("_lo") + F.col("_hi"), "first").otherwise("second"),
    ).drop("_t", "_lo", "_hi")


def split_blocks(df: DataFrame, keys: Sequence[str], time: str, k: int) -> DataFrame:
    """``block`` 0..k-1: equal time spans, half open, the last closed."""
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(k))
    raw = F.floor((F.col("_t") - F.col("_lo")) / F.nullif(width, F.lit(0.0)))
    block = F.least(F.coalesce(raw, F.lit(0)), F.lit(k - 1)).cast("int")
    return _with_span(df, keys, time).withColumn("block", block).drop("_t", "_lo", "_hi")


def _with_span(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    series = W.partitionBy(*keys)
    return (
        df.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")))
        .withColumn("_lo", F.min("_t").over(series))
        .withColumn("_hi", F.max("_t").over(series))
    )


def train_eval_split(
    df: DataFrame, keys: Sequence[str], time: str, value: str, share: float = 0.7, min_values: int = 4380
) -> DataFrame:
    """Finite rows up to and including position int(share * n) (from 0) train, the rest evaluate."""
    series = W.partitionBy(*keys)
    order = series.orderBy(time)
    cut = F.floor(F.lit(share) * F.col("_n")) + 1
    return (
        df.where(finite(F.col(value)).isNotNull())
        .withColumn("_n", F.count(F.lit(1)).over(series))
        .where(F.col("_n") >= min_values)
        .withColumn("_rank", F.row_number().over(order))
        .withColumn("split", F.when(F.col("_rank") <= cut, "train").otherwise("eval"))
        .drop("_rank", "_n")
    )


def water_year(day: str) -> Column:
    """October-September year, labelled by the year it starts in."""
    return F.year(day) - F.when(F.month(day) < 10, 1).otherwise(0)


def water_year_days(df: DataFrame, keys: Sequence[str], day: str, min_days: int = 100) -> DataFrame:
    """Day count per water year, keeping years with more than ``min_days``."""
    return (
        df.groupBy(*keys, water_year(day).alias("water_year"))
        .agg(F.count(F.lit(1)).alias("n_days"))
        .where(F.col("n_days") > min_days)
    )
