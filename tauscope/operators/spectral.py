"""Memory times and spectra for many series at once.

Spark has no FFT, so the Python in this module is a few vectorised helpers that see one array:
a packed series (one value per calendar bin, so some thousand numbers) or a chunk of one. Grouping,
shuffling, memory times and regression are DataFrame operations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tauscope.functions.expressions import de_number, finite, safe_log10
from tauscope.functions.ranks import bucketed_row_number
from tauscope.operators.prep import once

DOUBLES = T.ArrayType(T.DoubleType())


def series_index(df: DataFrame, keys: Sequence[str], time: str, value: str, name: str = "i") -> DataFrame:
    """Drop nulls and number the remaining rows 0..n-1 in time, one year per task."""
    known = df.where(finite(F.col(value)).isNotNull())
    out = bucketed_row_number(known, keys, [time], F.year(time), name)
    return out.withColumn(name, F.col(name) - 1)


def grid_index(df: DataFrame, keys: Sequence[str], day: str, name: str = "i") -> DataFrame:
    """Row numbers of a gap-free daily grid by date arithmetic, no sort needed."""
    first = F.min(day).over(W.partitionBy(*keys))
    return df.withColumn(name, F.datediff(day, first).cast("long"))


def pack(df: DataFrame, keys: Sequence[str], index: str, value: str) -> DataFrame:
    """One row per series: ``xs``, its values in order of the index, nulls left out."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(index).alias("_i"), F.col(value).cast("double").alias("_x"))))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(rows.getField("_x").alias("xs"))


def lag_shares(max_lag: int):
    """Vectorised helper: biased autocorrelation of a series at lags 0..min(max_lag, n-1) by one padded transform."""

    @F.pandas_udf(DOUBLES)
    def shares(series: pd.Series) -> pd.Series:
        return pd.Series([lag_shares_of(x, max_lag) for x in series], dtype=object)

    return once(shares)


def lag_shares_of(x: np.ndarray, max_lag: int) -> np.ndarray | None:
    if len(x) < 3:
        return None
    x, lags = x - x.mean(), min(max_lag, len(x) - 1) + 1
    power = np.abs(np.fft.rfft(x, 1 << int(len(x) + lags - 1).bit_length())) ** 2
    sums, energy = np.fft.irfft(power)[:lags], x @ x
    return np.ones(lags) if energy == 0 else np.concatenate([[1.0], sums[1:] / energy])


def acf(df: DataFrame, keys: Sequence[str], index: str, value: str, max_lag: int = 730) -> DataFrame:
    """Biased autocorrelation: (keys, lag, acf, n) for lag 0..min(max_lag, n-1).

    A constant series has acf 1 at every lag. Series under three values are dropped.
    """
    return packed_acf(pack(df, keys, index, value), keys, max_lag)


def packed_acf(series: DataFrame, keys: Sequence[str], max_lag: int = 730) -> DataFrame:
    """:func:`acf` of packed series."""
    sized = series.select(*keys, F.size("xs").cast("long").alias("_n"), lag_shares(max_lag)("xs").alias("_acf"))
    return sized.select(*keys, "_n", F.posexplode("_acf").alias("lag", "acf")).select(*keys, "lag", "acf", F.col("_n").alias("n"))


def packed_tau(series: DataFrame, keys: Sequence[str], max_lag: int = 730, carry: Sequence[str | Column] = ()) -> DataFrame:
    """:func:`tau_integral` of packed series: (keys, carried columns, tau, censored), one row per series."""
    found = series.select(*keys, *carry, lag_shares(max_lag)("xs").alias("_acf")).where(F.col("_acf").isNotNull())
    end = F.array_position(F.transform("_acf", lambda a: a <= 0), F.lit(True)).cast("int")
    used = found.withColumn("_end", end).withColumn("_used", F.when(F.col("_end") > 0, F.slice("_acf", F.lit(1), F.col("_end") - 1)).otherwise(F.col("_acf")))
    area = F.aggregate("_used", F.lit(0.0), lambda total, a: total + a)
    edges = F.element_at("_used", 1) + F.element_at("_used", -1)
    return used.withColumn("tau", area - F.lit(0.5) * edges).withColumn("censored", F.col("_end") == 0).drop("_acf", "_end", "_used")


def tau_integral(acf_rows: DataFrame, keys: Sequence[str], dt: float = 1.0) -> DataFrame:
    """Trapezoid of the acf up to (not including) its first non-positive lag, times dt.

    ``censored`` marks series whose acf never reaches 0 inside the lag range.
    """
    series = W.partitionBy(*keys)
    cut = F.min(F.when((F.col("lag") >= 1) & (F.col("acf") <= 0), F.col("lag"))).over(series)
    kept = acf_rows.withColumn("_cut", cut).where(F.col("_cut").isNull() | (F.col("lag") < F.col("_cut")))
    edges = F.max_by("acf", "lag") + F.min_by("acf", "lag")
    return kept.groupBy(*keys).agg(
        (F.lit(dt) * (F.sum("acf") - F.lit(0.5) * edges)).alias("tau"),
        F.max("_cut").isNull().alias("censored"),
    )


def masked_lag_sums(max_lag: int):
    """Vectorised helper: for lags 1..max_lag and t inside each chunk, over pairs where both values are known, the pairs, sums, squares and products."""

    @F.pandas_udf(DOUBLES)
    def sums(places: pd.Series, values: pd.Series, width: pd.Series) -> pd.Series:
        out = []
        for at, block, size in zip(places, values, width):
            x, known = np.zeros(size + max_lag), np.zeros(size + max_lag)
            x[np.asarray(at, dtype=int)], known[np.asarray(at, dtype=int)] = block, 1.0
            a, m = x[:size], known[:size]
            pairs = [(known, m), (known, a), (x, m), (known, a * a), (x * x, m), (x, a)]  # n, x, y, xx, yy, xy
            out.append(np.stack([np.correlate(later, own, "valid")[1:] for later, own in pairs], axis=1).ravel())
        return pd.Series(out)

    return sums


def tau_positive_acf(
    df: DataFrame, keys: Sequence[str], index: str, value: str,
    max_lag: int = 120, min_values: int = 60, min_pairs: int = 30,
) -> DataFrame:
    """1 + 2 * sum of Pearson lag correlations, stopping at the first unusable lag.

    A series is cut into chunks of its index with ``max_lag`` places of look-ahead; a chunk gives the sums over its pairs at every
    lag, missing values masked, and the sums of a series' chunks are added up.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(index).cast("long").alias("_i"), F.col(value).cast("double").alias("_x"))
    sizes = known.groupBy(*keys).agg(F.count("_x").alias("n"), F.avg("_x").alias("_mean")).where(F.col("n") >= min_values)
    width = max(max_lag, 512)
    home = F.floor(F.col("_i") / F.lit(float(width)))
    placed = known.join(sizes.select(*keys, "_mean"), list(keys)).select(
        *keys, "_i", (F.col("_x") - F.col("_mean")).alias("_x"), F.explode(F.array(home, home - 1)).alias("_chunk")
    ).withColumn("_at", F.col("_i") - F.col("_chunk") * width).where((F.col("_at") < width + max_lag) & (F.col("_chunk") >= 0))
    chunks = placed.groupBy(*keys, "_chunk").agg(F.collect_list(F.struct("_at", "_x")).alias("_rows"))
    flat = masked_lag_sums(max_lag)(F.col("_rows._at"), F.col("_rows._x"), F.lit(width))
    six = F.transform(F.sequence(F.lit(0), F.lit(max_lag - 1)), lambda k: F.slice(F.col("_flat"), (k * 6 + 1).cast("int"), 6))
    per_lag = chunks.select(*keys, flat.alias("_flat")).select(*keys, F.posexplode(six).alias("_k", "_s"))
    names = ["_n", "_sx", "_sy", "_sxx", "_syy", "_sxy"]
    total = per_lag.groupBy(*keys, (F.col("_k") + 1).alias("lag")).agg(*[F.sum(F.col("_s")[i]).alias(c) for i, c in enumerate(names)])
    n = F.col("_n")
    cross = n * F.col("_sxy") - F.col("_sx") * F.col("_sy")
    vx, vy = n * F.col("_sxx") - F.col("_sx") * F.col("_sx"), n * F.col("_syy") - F.col("_sy") * F.col("_sy")
    flatness = 1e-12 * n  # sums of a constant side cancel up to rounding
    usable = (vx > flatness * F.col("_sxx")) & (vy > flatness * F.col("_syy"))
    rho = total.where(n > 0).select(*keys, "lag", n.alias("_pairs"), F.when(usable, cross / F.sqrt(vx * vy)).alias("rho"))
    bad = (F.col("_pairs") < min_pairs) | F.col("rho").isNull() | (F.col("rho") <= 0)
    stop = F.min(F.when(bad, F.col("lag"))).over(W.partitionBy(*keys))
    used = rho.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("lag") < F.col("_stop")))
    summed = used.groupBy(*keys).agg(F.sum("rho").alias("_sum"), F.max("lag").alias("lags_used"))
    return sizes.join(summed, list(keys), "left").select(
        *keys, "n", (F.lit(1.0) + F.lit(2.0) * F.coalesce("_sum", F.lit(0.0))).alias("tau"),
        F.coalesce("lags_used", F.lit(0)).alias("lags_used"),
    )


def tau_recession_segments(
    df: DataFrame, keys: Sequence[str], day: str, q: str, log_floor: float | None = 1e-6,
    min_run: int = 5, min_segments: int = 3, min_values: int = 365,
) -> DataFrame:
    """Mean decay rate over low-flow recession runs, as a time in days (0.1 steps).

    A run is a stretch of falling log q below the 30th percentile. The last row of a
    series cannot close a run, so a run that reaches it ends one row early.
    """
    series = W.partitionBy(*keys)
    order = series.orderBy(day)
    usable = df.where(F.col(q).isNotNull()) if log_floor else df.where(F.col(q) > 0)
    level = F.log(F.greatest(F.col(q), F.lit(log_floor))) if log_floor else F.log(q)
    marked = (
        usable.withColumn("_low", F.percentile(q, F.lit(0.3)).over(series))
        .withColumn("_lq", level)
        .withColumn("_r", F.row_number().over(order))
        .withColumn("_last", F.count(F.lit(1)).over(series))
        .withColumn("_fall", F.col("_lq") < F.lag("_lq").over(order))
    )
    inside = F.coalesce(F.col("_fall"), F.lit(False)) & (F.col(q) < F.col("_low")) & (F.col("_r") < F.col("_last")) & (F.col("_last") >= min_values)
    runs = (
        marked.withColumn("_in", inside)
        .withColumn("_run", F.sum(F.when(F.col("_in"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
        .where("_in")
    )
    slopes = runs.groupBy(*keys, "_run").agg(
        F.count(F.lit(1)).alias("_n"), (-F.regr_slope("_lq", F.col("_r").cast("double"))).alias("_k")
    )
    slopes = slopes.where((F.col("_n") >= min_run) & (F.col("_k") > 0) & (F.col("_k") < 1))
    return (
        slopes.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_segments"), F.round(F.lit(1.0) / F.avg("_k"), 1).alias("tau"))
        .where(F.col("n_segments") >= min_segments)
    )


def tau_recession_simple(
    df: DataFrame, keys: Sequence[str], day: str, q: str, prob: float = 0.3,
    min_values: int = 365, min_days: int = 10,
) -> DataFrame:
    """1 / -mean(change of log q) over falling days below a low-flow percentile."""
    series = W.partitionBy(*keys)
    change = F.log(q) - F.lag(F.log(q)).over(series.orderBy(day))
    work = (
        df.where(F.col(q) > 0)
        .withColumn("_d", change)
        .withColumn("_low", F.percentile(q, F.lit(prob)).over(series))
        .withColumn("_n", F.count(F.lit(1)).over(series))
        .where((F.col("_n") >= min_values) & (F.col("_d") < 0) & (F.col(q) < F.col("_low")))
    )
    return work.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"), (F.lit(1.0) / F.nullif(-F.avg("_d"), F.lit(0.0))).alias("tau")
    ).where(F.col("n_days") >= min_days)


def mean_periodogram(nperseg: int):
    """Vectorised helper: mean over half-overlapping segments of the one-sided |rFFT|^2 / sum(w^2), each mean-free and Hann-weighted."""

    @F.pandas_udf(DOUBLES)
    def density(series: pd.Series) -> pd.Series:
        return pd.Series([density_of(x, nperseg) for x in series], dtype=object)

    return once(density)


def density_of(x: np.ndarray, nperseg: int) -> np.ndarray | None:
    size = min(nperseg, len(x))
    if size < 4:
        return None
    block = np.lib.stride_tricks.sliding_window_view(x, size)[:: size - size // 2]
    taper = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(size) / size)
    block = (block - block.mean(axis=1, keepdims=True)) * taper
    power = (np.abs(np.fft.rfft(block, axis=1)) ** 2).mean(axis=0) / np.sum(taper**2)
    power[1 : (size + 1) // 2] *= 2.0
    return power


def welch_psd(
    df: DataFrame, keys: Sequence[str], index: str, value: str, fs: float | Column = 1.0, nperseg: int = 256
) -> DataFrame:
    """Welch density (Hann, half overlap, mean removed): (keys, k, frequency, psd, n_segments)."""
    return packed_welch(pack(df, keys, index, value), keys, fs, nperseg)


def packed_welch(
    series: DataFrame, keys: Sequence[str], fs: float | Column = 1.0, nperseg: int = 256, carry: Sequence[str] = ()
) -> DataFrame:
    """:func:`welch_psd` of packed series; ``carry`` names columns of a series to repeat on its rows."""
    return density_rows(series.select(*keys, *carry, F.size("xs").alias("_n"), mean_periodogram(nperseg)("xs").alias("_p")), keys, fs, nperseg, carry)


def density_rows(
    series: DataFrame, keys: Sequence[str], fs: float | Column = 1.0, nperseg: int | Column = 256, carry: Sequence[str] = ()
) -> DataFrame:
    """Rows of the density arrays ``_p`` of series with ``_n`` values."""
    fs = fs if isinstance(fs, Column) else F.lit(float(fs))
    sized = series.withColumn("_size", F.least(nperseg if isinstance(nperseg, Column) else F.lit(nperseg), F.col("_n")).cast("long"))
    sized = sized.withColumn("n_segments", F.expr("(_n - _size) div (_size - _size div 2) + 1"))
    return (
        sized.select(*keys, *carry, "_size", "n_segments", F.posexplode("_p").alias("_k", "_d"))
        .where((F.col("_k") > 0) & (F.col("_d") > 0))
        .select(*keys, *carry, F.col("_k").alias("k"), (F.col("_k") * fs / F.col("_size")).alias("frequency"), (F.col("_d") / fs).alias("psd"), "n_segments")
    )


def median_step(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Sampling rate in Hz from the median positive time step of each series."""
    step = (
        F.unix_micros(F.col(time).cast("timestamp"))
        - F.lag(F.unix_micros(F.col(time).cast("timestamp"))).over(W.partitionBy(*keys).orderBy(time))
    ) / F.lit(1e6)
    steps = df.withColumn("_step", step).where(F.col("_step") > 0)
    return steps.groupBy(*keys).agg(
        (F.lit(1.0) / F.median("_step")).alias("fs"), F.median("_step").alias("median_step")
    )


def lomb_scargle(
    df: DataFrame, keys: Sequence[str], seconds: str, value: str, n_freqs: int = 512,
    rates: DataFrame | None = None,
) -> DataFrame:
    """Normalised Lomb-Scargle power on a geometric grid: (keys, k, frequency, psd).

    The lowest frequency is 1/span; the highest is half of ``fs`` from ``rates`` (keys, fs),
    by default half the mean record rate. Each record is multiplied by the bounded frequency
    grid and reduced on the map side to five sums per (series, frequency), so records
    are never gathered per series.
    """
    stats = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min(seconds).alias("_t0"), F.max(seconds).alias("_t1"),
        F.avg(value).alias("_mean"), F.count(value).alias("_n"),
    )
    span = F.col("_t1") - F.col("_t0")
    if rates is None:
        stats = stats.withColumn("fs", (F.col("_n") - 1) / F.nullif(span, F.lit(0.0)))
    else:
        stats = stats.join(rates.select(*keys, "fs"), list(keys))
    low = F.lit(1.0) / F.nullif(span, F.lit(0.0))
    stats = stats.withColumn("_f0", low).withColumn("_f1", F.lit(0.5) * F.col("fs")).where(
        (F.col("_n") >= 4) & (F.col("_f0") > 0) & (F.col("_f1") > F.col("_f0"))
    )
    power = F.col("k") / F.lit(float(n_freqs - 1))
    work = (
        df.where(F.col(value).isNotNull())
        .join(stats, list(keys))
        .select(
            *keys, (F.col(seconds) - F.col("_t0")).alias("_t"), (F.col(value) - F.col("_mean")).alias("_y"),
            "_f0", "_f1", F.explode(F.sequence(F.lit(0), F.lit(n_freqs - 1))).alias("k"),
        )
        .withColumn("frequency", F.col("_f0") * F.pow(F.col("_f1") / F.col("_f0"), power))
        .withColumn("_w", F.lit(2.0 * math.pi) * F.col("frequency") * F.col("_t"))
        .withColumn("_c", F.cos("_w"))
        .withColumn("_s", F.sin("_w"))
    )
    y, c, s = F.col("_y"), F.col("_c"), F.col("_s")
    sums = work.groupBy(*keys, "k").agg(
        F.first("frequency").alias("frequency"),
        F.sum(y * c).alias("_yc"), F.sum(y * s).alias("_ys"), F.sum(c * c).alias("_cc"),
        F.sum(s * s).alias("_ss"), F.sum(c * s).alias("_cs"), F.sum(y * y).alias("_yy"),
    )
    turn = F.lit(0.5) * F.atan2(F.lit(2.0) * F.col("_cs"), F.col("_cc") - F.col("_ss"))
    ct, st = F.cos("_turn"), F.sin("_turn")
    cross = F.lit(2.0) * ct * st * F.col("_cs")
    cos_part = F.pow(ct * F.col("_yc") + st * F.col("_ys"), F.lit(2.0)) / F.nullif(
        ct * ct * F.col("_cc") + cross + st * st * F.col("_ss"), F.lit(0.0)
    )
    sin_part = F.pow(ct * F.col("_ys") - st * F.col("_yc"), F.lit(2.0)) / F.nullif(
        ct * ct * F.col("_ss") - cross + st * st * F.col("_cc"), F.lit(0.0)
    )
    psd = (F.coalesce(cos_part, F.lit(0.0)) + F.coalesce(sin_part, F.lit(0.0))) / F.nullif(F.col("_yy"), F.lit(0.0))
    return sums.withColumn("_turn", turn).select(*keys, "k", "frequency", psd.alias("psd")).where(F.col("psd") > 0)


def local_slope(
    psd: DataFrame, keys: Sequence[str], window_decades: float = 0.75, min_points: int = 8,
    power: str = "psd", carry: Sequence[str] = ("k",),
) -> DataFrame:
    """Least-squares log-log slope in a sliding window: beta = -slope.

    A RANGE frame over log10 frequency; one series holds one row per frequency.
    """
    half = window_decades / 2.0
    points = (
        psd.where((F.col("frequency") > 0) & (F.col(power) > 0))
        .withColumn("_lf", F.log10("frequency"))
        .withColumn("_lp", F.log10(power))
    )
    series = ", ".join(f"`{k}`" for k in keys)
    frame = (
        f"OVER (PARTITION BY {series} ORDER BY _lf "
        f"RANGE BETWEEN {half!r}D PRECEDING AND {half!r}D FOLLOWING)"
    )
    near = lambda call: F.expr(f"{call} {frame}")
    fits = points.select(
        *keys, *carry, F.col("frequency").alias("f_center"),
        (-near("regr_slope(_lp, _lf)")).alias("beta"),
        near("regr_intercept(_lp, _lf)").alias("intercept"),
        near("count(1)").alias("n_points"),
        near("regr_r2(_lp, _lf)").alias("r2"),
        near("min(_lf)").alias("log10_f_min"),
        near("max(_lf)").alias("log10_f_max"),
    )
    return fits.where(F.col("n_points") >= min_points)


def packed_slopes(min_points: int = 8):
    """Vectorised helper: :func:`local_slope` of density arrays; the slope at every frequency k / size, null where there is none.

    A slope is a weighted sum of the logs of the density, and series with a density at the same places share their weights.
    """

    @F.pandas_udf(DOUBLES)
    def slopes(density: pd.Series, window: pd.Series) -> pd.Series:
        known: dict = {}
        return pd.Series([slopes_of(power, width, known, min_points) for power, width in zip(density, window)], dtype=object)

    return once(slopes)


def slope_weights(ks: np.ndarray, half: float, min_points: int) -> np.ndarray:
    lf = np.log10(ks)
    near = np.abs(lf[:, None] - lf[None, :]) <= half
    count = near.sum(axis=1, keepdims=True)
    off = np.where(near, lf[None, :] - (near @ lf)[:, None] / count, 0.0)
    spread = (off**2).sum(axis=1, keepdims=True)
    return np.where((count >= min_points) & (spread > 0), -off / np.where(spread > 0, spread, 1.0), np.nan)


def slopes_of(power: np.ndarray | None, width: float, known: dict, min_points: int) -> np.ndarray | None:
    """Slopes of one density; ``known`` keeps the weights of up to 32 patterns of places."""
    if power is None:
        return None
    ks = np.flatnonzero(power > 0)
    ks = ks[ks > 0]
    row = np.full(len(power), np.nan)
    places = (width, ks.tobytes())
    made = known.get(places)
    if made is None:
        made = slope_weights(ks, float(width) / 2.0, min_points)
        if len(known) < 32:
            known[places] = made
    row[ks] = made @ np.log10(power[ks])
    return row


def curve_of(max_lag: int = 730, nperseg: int = 256, window: float = 0.9, min_points: int = 8):
    """A function from one anomaly series to its curve as an array (tau, size, slopes at k / size); None without a positive memory time or a slope."""
    known: dict = {}

    def curve(x: np.ndarray) -> np.ndarray | None:
        shares = lag_shares_of(x, max_lag)
        if shares is None:
            return None
        ends = np.flatnonzero(shares <= 0)
        used = shares[: ends[0]] if len(ends) else shares
        tau = np.cumsum(used)[-1] - 0.5 * (used[0] + used[-1])
        betas = slopes_of(density_of(x, nperseg), window, known, min_points) if tau > 0 else None
        if betas is None or np.isnan(betas).all():
            return None
        return np.concatenate([[tau, min(nperseg, len(x))], betas])

    return curve


def curve_columns(found: Column) -> list[Column]:
    """The columns tau, size, betas of a result of :func:`curve_of`."""
    return [found[0].alias("tau"), found[1].cast("int").alias("size"), F.slice(found, F.lit(3), F.greatest(F.size(found) - 2, F.lit(0))).alias("betas")]


def de_coordinate(slopes: DataFrame, tau: Column) -> DataFrame:
    """Attach ``de = f * tau`` and its log; rows without a positive tau are dropped."""
    return (
        slopes.withColumn("de", de_number(F.col("f_center"), tau))
        .where(F.col("de").isNotNull())
        .withColumn("log10_de", safe_log10(F.col("de")))
    )


def beta_window(curve: DataFrame, keys: Sequence[str], de_min: float = 0.5, de_max: float = 2.0) -> DataFrame:
    """Counts, means and medians of beta overall and for de inside the window.

    Grouped medians are per series, at most one value per frequency.
    """
    beta = finite(F.col("beta"))
    inside = F.when(F.col("de").between(de_min, de_max), beta)
    return curve.groupBy(*keys).agg(
        F.count(beta).alias("n_beta_rows"),
        F.avg(beta).alias("mean_beta_all"),
        F.median(beta).alias("median_beta_all"),
        F.count(inside).alias("n_beta_de_window"),
        F.avg(inside).alias("mean_beta_de_window"),
        F.median(inside).alias("median_beta_de_window"),
    )


def curve_features(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shape of beta against log de: side slopes, middle mean and range, de at the minimum."""
    x, b, de = F.col("log10_de"), F.col("beta"), F.col("de")
    order = W.partitionBy(*keys).orderBy("de")
    smooth = (
        F.coalesce(F.lag("beta").over(order), F.lit(0.0)) + b + F.coalesce(F.lead("beta").over(order), F.lit(0.0))
    ) / F.lit(3.0)

    def side(mask: Column) -> Column:
        xs, bs = F.when(mask, x), F.when(mask, b)
        return F.when(F.count(xs) >= 3, F.regr_slope(bs, xs))

    mid = F.when(de.between(0.5, 2.0), b)
    lowest = F.struct("_smooth", "de")
    enough = F.count(F.lit(1)) >= 10
    return (
        curve.where(b.isNotNull())
        .withColumn("_smooth", smooth)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_points"),
            side(de > 2).alias("high_de_slope"),
            side(de < 0.5).alias("low_de_slope"),
            F.when(F.count(mid) >= 3, F.avg(mid)).alias("mean_beta_mid"),
            F.when(F.count(mid) >= 3, F.max(mid) - F.min(mid)).alias("beta_range_mid"),
            F.when(enough, F.min_by("de", lowest)).alias("de_at_min_beta"),
            F.when(enough, F.min_by("beta", lowest)).alias("min_beta"),
        )
        .where(F.col("n_points") >= 5)
    )


def ar1_phi(tau: Column) -> Column:
    """Lag-one coefficient whose integral memory is ``tau`` samples, kept in [0, 0.995]."""
    phi = (tau - F.lit(0.5)) / (tau + F.lit(0.5))
    return F.greatest(F.lit(0.0), F.least(F.lit(0.995), phi))


def _clipped(frequency: Column) -> Column:
    return F.greatest(F.lit(1e-8), F.least(F.lit(0.499999), frequency))


def ar1_psd(frequency: Column, tau: Column) -> Column:
    """AR(1) spectrum shape with phi = exp(-1/tau); frequency per sample."""
    phi = F.greatest(F.lit(-0.995), F.least(F.lit(0.995), F.exp(F.lit(-1.0) / F.greatest(tau, F.lit(0.2)))))
    turn = F.lit(2.0) * phi * F.cos(F.lit(2.0 * math.pi) * _clipped(frequency))
    return F.lit(1.0) / F.greatest(F.lit(1.0) + phi * phi - turn, F.lit(1e-12))


def two_timescale_psd(frequency: Column, tau: Column) -> Column:
    """Weighted sum of a fast (tau/6) and a slow (6 tau) AR(1) spectrum with mean memory tau."""
    fast = F.greatest(F.lit(1.0), tau / F.lit(6.0))
    slow = F.least(F.lit(730.0), F.greatest(tau * F.lit(6.0), fast + F.lit(1.0)))
    share = F.greatest(F.lit(0.25), F.least(F.lit(0.9), (tau - slow) / F.nullif(fast - slow, F.lit(0.0))))
    return share * ar1_psd(frequency, fast) + (F.lit(1.0) - share) * ar1_psd(frequency, slow)


def arfima_psd(frequency: Column, tau: Column, d: Column) -> Column:
    """AR(1) spectrum times the long-memory factor (2 sin(pi f))^(-2 d)."""
    d = F.greatest(F.lit(0.02), F.least(F.lit(0.45), d))
    root = F.greatest(F.lit(2.0) * F.sin(F.lit(math.pi) * _clipped(frequency)), F.lit(1e-8))
    return ar1_psd(frequency, tau) * F.pow(root, F.lit(-2.0) * d)


def analytic_spectra(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per series and process family with the density ``_p`` at the places of the series' slopes; ARFIMA in three memory strengths.

    ``packed`` holds (keys, tau, size, betas), a row per series, and keeps its columns.
    """
    t = F.col("tau")
    shapes = {
        "analytic_ar1": lambda f: ar1_psd(f, t),
        "analytic_two_timescale_ar": lambda f: two_timescale_psd(f, t),
        "analytic_arfima_d0.15": lambda f: arfima_psd(f, t, F.lit(0.15)),
        "analytic_arfima_d0.28": lambda f: arfima_psd(f, t, F.lit(0.28)),
        "analytic_arfima_d0.40": lambda f: arfima_psd(f, t, F.lit(0.40)),
    }
    at = lambda shape: F.transform("betas", lambda b, k: F.when(b.isNotNull(), shape(k / F.col("size"))))
    families = F.array(*[F.struct(F.lit(name).alias("family"), at(shape).alias("_p")) for name, shape in shapes.items()])
    return packed.select(*keys, "tau", "size", "betas", F.inline(families))


def analytic_slopes(packed: DataFrame, keys: Sequence[str], window: float = 0.9, min_points: int = 8) -> DataFrame:
    """Slopes of :func:`analytic_spectra` beside the observed ones: (keys, family, tau, size, betas, observed), packed, so nothing is shuffled or joined."""
    slopes = packed_slopes(min_points)("_p", F.lit(float(window))).alias("betas")
    return analytic_spectra(packed, keys).select(*keys, "family", "tau", "size", slopes, F.col("betas").alias("observed"))


def ar1_beta(frequency: Column, tau: Column) -> Column:
    """Closed-form local slope -dlogP/dlogf of an AR(1) process; frequency per sample."""
    omega = F.lit(2.0 * math.pi) * frequency
    phi = ar1_phi(tau)
    denominator = F.lit(1.0) + phi * phi - F.lit(2.0) * phi * F.cos(omega)
    return F.lit(2.0) * phi * omega * F.sin(omega) / F.nullif(denominator, F.lit(0.0))
