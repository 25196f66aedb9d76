"""Composite jobs: one plan from daily rows to curve points, for all gauges at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tauscope.functions.expressions import SECONDS_PER_DAY, energy_joule
from tauscope.operators import prep, spectral
from tauscope.operators.binning import packed_reduction
from tauscope.session import materialise


def gauge_anomaly(daily: DataFrame, keys: Sequence[str], day: str = "day", value: str = "q") -> DataFrame:
    """Mean climatology out, plain MAD scale, row index on a gap-free daily grid."""
    work = prep.deseason(daily, keys, day, value, "mean").drop("seasonal_cycle")
    return spectral.grid_index(prep.mad_plain(work, keys, value), keys, day)


def gauge_curves(
    anomaly: DataFrame, keys: Sequence[str], value: str = "q", max_lag: int = 730, nperseg: int = 256,
    window: float = 0.9, min_points: int = 8, tau: DataFrame | None = None,
) -> DataFrame:
    """Curve points (keys, k, tau, frequency per day, de, log10_de, beta) of usable gauges.

    A gauge whose memory time is 0 has no de and drops out. ``tau`` may be given to put
    the spectra on another memory coordinate.
    """
    return packed_curves(spectral.pack(anomaly, keys, "i", value), keys, max_lag, nperseg, window, min_points, tau)


def packed_curves(
    series: DataFrame, keys: Sequence[str], max_lag: int = 730, nperseg: int = 256, window: float = 0.9, min_points: int = 8,
    tau: DataFrame | None = None,
) -> DataFrame:
    """:func:`gauge_curves` of packed anomalies: memory time, spectrum and slopes leave a series together, so nothing is joined, shuffled or read twice."""
    return slope_points(series_slopes(series, keys, max_lag, nperseg, window, min_points, tau), keys)


def series_slopes(
    series: DataFrame, keys: Sequence[str], max_lag: int = 730, nperseg: int = 256, window: float = 0.9, min_points: int = 8,
    tau: DataFrame | None = None,
) -> DataFrame:
    """The curve of a series in one row: (keys, tau, size, betas), with the slope at frequency k / size in place k, null where there is none.

    Series without a positive memory time or without any slope drop out.
    """
    density = [F.size("xs").alias("_n"), spectral.mean_periodogram(nperseg)("xs").alias("_p")]
    if tau is None:
        both = spectral.packed_tau(series, keys, max_lag, density)
    else:
        both = series.select(*keys, *density).join(tau.select(*keys, "tau"), list(keys))
    slopes = both.where(F.col("tau") > 0).select(
        *keys, "tau", F.least(F.lit(nperseg), F.col("_n")).alias("size"), spectral.packed_slopes(min_points)("_p", F.lit(float(window))).alias("betas")
    )
    return slopes.where(F.exists("betas", lambda b: b.isNotNull()))


def flow_slopes(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`series_slopes` of the anomalies of recorded days (keys, _rows): days go into one helper and only slopes leave it."""
    measure = spectral.curve_of()

    def work(first, x):
        return [measure(prep.anomaly_of(first, x))]

    found = days.select(*keys, prep.per_series(work)("_rows.d", "_rows.v")[0].alias("_found")).where(F.col("_found").isNotNull())
    return found.select(*keys, *spectral.curve_columns(F.col("_found")))


def slope_points(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Curve points of :func:`series_slopes`."""
    rows = packed.select(*keys, "tau", "size", F.posexplode("betas").alias("k", "beta")).where(F.col("beta").isNotNull())
    points = spectral.de_coordinate(rows.withColumn("f_center", F.col("k") / F.col("size")), F.col("tau"))
    return points.select(
        *keys, "k", "tau", F.col("f_center").alias("frequency"),
        (F.col("f_center") / F.lit(SECONDS_PER_DAY)).alias("frequency_hz"), "de", "log10_de", "beta",
    )


def flow_anomaly(series: DataFrame) -> DataFrame:
    """:func:`gauge_anomaly` of packed daily series (first, xs)."""
    return series.withColumn("xs", prep.once(prep.plain_anomaly)("first", "xs"))


def analyze_series(
    df: DataFrame, keys: Sequence[str], time: str, value: str, tau_days: float, rule: str | None = None,
    how: str = "mean", season: bool = True, unit: str = "D", method: str = "welch", nperseg: int = 256,
    n_freqs: int = 512,
) -> dict[str, DataFrame]:
    """Resample, de-season, detrend, scale, spectrum, slope and de as four lazy tables."""
    if tau_days <= 0:
        raise ValueError("tau_days must be positive")
    work = df.select(*keys, F.col(time).alias("time"), F.col(value).alias("value"))
    if rule:
        work = prep.resample(work, keys, "time", F.col("value"), rule, how)
    if season:
        work = prep.deseason(work, keys, "time", "value", "median", unit)
    work = prep.robust_z(prep.detrend_linear(work, keys, "time", "value"), keys, "value")
    if method == "welch":
        rate = spectral.median_step(work.where(F.col("value").isNotNull()), keys, "time")
        indexed = spectral.series_index(work, keys, "time", "value")
        psd = spectral.welch_psd(indexed, keys, "i", "value", 1.0, nperseg).join(rate, list(keys))
        psd = psd.select(
            *keys, "k", (F.col("frequency") * F.col("fs")).alias("frequency"), (F.col("psd") / F.col("fs")).alias("psd")
        )
    elif method == "lomb_scargle":
        seconds = work.withColumn("_s", F.unix_micros(F.col("time").cast("timestamp")) / F.lit(1e6))
        rate = spectral.median_step(work, keys, "time")
        psd = spectral.lomb_scargle(seconds, keys, "_s", "value", n_freqs, rate)
    else:
        raise ValueError(f"unsupported method: {method}")
    slopes = spectral.local_slope(psd, keys)
    beta_de = spectral.de_coordinate(slopes, F.lit(tau_days * SECONDS_PER_DAY))
    return {"processed": work, "psd": psd, "beta": slopes, "beta_de": beta_de}


def tau_sweep(slopes: DataFrame, keys: Sequence[str], tau_days: Sequence[float]) -> DataFrame:
    """One spectrum placed on several assumed memory times, summarised per memory time."""
    taus = F.explode(F.array(*[F.lit(float(t)) for t in tau_days]))
    swept = spectral.de_coordinate(
        slopes.withColumn("tau_days", taus), F.col("tau_days") * F.lit(SECONDS_PER_DAY)
    )
    return spectral.beta_window(swept, [*keys, "tau_days"])


def gauge_summary(tau: DataFrame, window: DataFrame, keys: Sequence[str], min_rows: int) -> DataFrame:
    """One audit row per gauge with the first gate it fails."""
    reason = (
        F.when(F.col("tau") <= 0, "invalid_tau_acf")
        .when(F.col("n_beta_rows").isNull(), "empty_beta_curve")
        .when(F.col("n_beta_rows") < min_rows, "few_beta_rows")
        .otherwise("included")
    )
    return tau.join(window, list(keys), "left").select(
        *keys, "tau", F.coalesce("n_beta_rows", F.lit(0)).alias("n_curve_rows"), "mean_beta_de_window", reason.alias("reason")
    )


def estimator_grid(
    series: DataFrame, keys: Sequence[str], npersegs: Sequence[int], windows: Sequence[float], min_units: int, max_lag: int = 730, n_bins: int = 24,
) -> DataFrame:
    """Reduction for every segment length and slope window; memory times and each spectrum are computed once.

    The spectra of all lengths are one small table with the length as a key. Slopes stay packed beside them, a row per gauge, length and
    window: only counts of cells, the values at the edges and the medians of bins are moved.
    """
    named = {n: f"_p{n}" for n in npersegs}
    both = spectral.packed_tau(series, keys, max_lag, [F.size("xs").alias("_n"), *[spectral.mean_periodogram(n)("xs").alias(c) for n, c in named.items()]])
    lengths = F.array(*[F.struct(F.lit(n).alias("nperseg"), F.col(c).alias("_p")) for n, c in named.items()])
    each = materialise(both.where((F.col("tau") > 0) & F.col(named[npersegs[0]]).isNotNull()).select("tau", "_n", F.inline(lengths)))
    each = each.withColumn("window", F.explode(F.array(*[F.lit(float(w)) for w in windows])))
    groups = ["nperseg", "window"]
    packed = each.select(*groups, "tau", F.least("nperseg", "_n").alias("size"), spectral.packed_slopes()("_p", "window").alias("betas"))
    return packed_reduction(packed, groups, min_units, n_bins=n_bins)


def event_sensitivity(
    events: DataFrame, keys: Sequence[str], floors: Sequence[float], rules: Sequence[str], tau_days: Sequence[float]
) -> DataFrame:
    """Slopes near the memory scale for magnitude floors x bin rules x (count, energy) x tau."""
    floor = F.explode(F.array(*[F.lit(float(f)) for f in floors]))
    work = events.withColumn("min_magnitude", floor).where(F.col("magnitude") >= F.col("min_magnitude"))
    group = [*keys, "min_magnitude"]
    parts = []
    for rule in rules:
        count = prep.resample(work, group, "time", F.lit(1.0), rule, "count").withColumn("variable", F.lit("count"))
        energy = prep.resample(work, group, "time", energy_joule(F.col("magnitude")), rule, "sum")
        parts.append(
            count.unionByName(energy.withColumn("variable", F.lit("energy"))).withColumn("rule", F.lit(rule))
        )
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    every = [*group, "rule", "variable"]
    scaled = prep.robust_z(stacked, every, "value")
    rate = spectral.median_step(scaled, every, "time")
    psd = spectral.welch_psd(spectral.series_index(scaled, every, "time", "value"), every, "i", "value")
    psd = psd.join(rate, every).withColumn("frequency", F.col("frequency") * F.col("fs"))
    return tau_sweep(spectral.local_slope(psd, every), every, tau_days)
