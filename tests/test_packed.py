"""Packed slopes of units: edges and medians as the tables of points give them."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tauscope.functions import ranks
from tauscope.operators import binning, prep, resampling, spectral
from tauscope.plans import archive


def near(got, want, by, columns):
    got, want = (df.toPandas().sort_values(by).reset_index(drop=True) for df in (got, want))
    assert len(got) == len(want) > 0 and (got[by].astype(str) == want[by].astype(str)).all().all()
    assert np.allclose(got[columns].astype(float), want[columns].astype(float), equal_nan=True, rtol=1e-9, atol=1e-12)


def test_quantiles_by_cells(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in np.round(rng.normal(size=500), 2)] + [("b", 1.5)] * 7 + [("c", -2.0), ("c", 3.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = {"lo": 0.025, "mid": 0.5, "hi": 0.975}
    near(ranks.cell_quantiles(df, ["g"], "x", probs), ranks.quantiles(df, ["g"], "x", probs), ["g"], list(probs))


def spectra(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(6):
        power = np.exp(rng.normal(size=65))
        if g == 1:
            power[[5, 30]] = 0.0
        rows.append((f"g{g}", 128, [float(p) for p in power], float(1 + g)))
    return spark.createDataFrame(rows, "g string, _n int, _p array<double>, tau double")


@pytest.mark.parametrize("window", [0.7, 1.1])
def test_packed_slopes_match_the_sliding_frames(spark, window):
    df = spectra(spark)
    rows = spectral.density_rows(df, ["g"], 1.0, 128)
    want = spectral.local_slope(rows, ["g"], window).select("g", "k", "beta")
    got = df.select("g", F.posexplode(spectral.packed_slopes()("_p", F.lit(window))).alias("k", "beta")).where(F.col("beta").isNotNull())
    near(got, want, ["g", "k"], ["beta"])


def test_packed_medians_match_the_points(spark):
    df = spectra(spark).withColumn("betas", spectral.packed_slopes()("_p", F.lit(0.9))).select("g", "tau", F.lit(128).alias("size"), "betas").cache()
    axes = {"f": F.lit(1.0), "de": F.col("tau")}
    packed = df.withColumn("all", F.lit("x"))
    points = packed.select("all", "g", "tau", "size", F.posexplode("betas").alias("k", "beta")).where(F.col("beta").isNotNull())
    points = points.withColumn("f", F.col("k") / F.col("size")).withColumn("de", F.col("f") * F.col("tau"))
    long = binning.unpivot_axes(points, ["all", "g", "beta"], {"f": "f", "de": "de"})
    arm = F.when(F.col("axis") == "f", 0).otherwise(1)
    want = binning.unit_bin_median(long, ["all", "axis"], "g", n_bins=7).withColumn("arm", arm)
    edges = binning.bin_edges(binning.packed_axes(packed, ["all"], axes), ["all", "axis"], 0.025, 0.975, 7, ranks.cell_quantiles).withColumn("arm", arm)
    got = binning.packed_medians(packed.withColumn("factors", F.array(*axes.values())), edges, ["all"], 7)
    near(got, want.orderBy("beta_median"), ["arm", "bin_id", "beta_median"], ["beta_median"])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_estimator_grid_moves_no_points(spark, monkeypatch):
    first = dt.date(1999, 11, 3)
    rng = np.random.default_rng(4)
    rows = [("X", f"g{g}", first + dt.timedelta(days=i), float(rng.integers(1, 9999)) / 100) for g in range(4) for i in range(600)]
    daily = spark.createDataFrame(rows, "archive string, gauge_id string, day date, q double")
    keys = ["archive", "gauge_id"]
    series = archive.flow_anomaly(prep.daily_series(daily, keys, "day", "q")).cache()
    got = archive.estimator_grid(series, keys, [64, 256], [0.7, 0.9], 2, 100)
    assert "Window" not in plan(got) and "percentile" not in plan(got)  # no frames over slopes, no grouped medians of units
    parts = None
    for n in (64, 256):
        for w in (0.7, 0.9):
            part = archive.packed_curves(series, keys, 100, n, w).withColumn("nperseg", F.lit(n)).withColumn("window", F.lit(w))
            parts = part if parts is None else parts.unionByName(part)
    want = binning.archive_reduction(parts, ["nperseg", "window"], "gauge_id", 2)
    near(got, want, ["nperseg", "window", "raw_bins", "de_bins"], ["raw_variance", "de_variance", "reduction"])


def test_bins_of_packed_slopes_move_no_points(spark):
    df = spectra(spark).withColumn("betas", spectral.packed_slopes()("_p", F.lit(0.9))).select(F.lit("x").alias("s"), "g", "tau", F.lit(128).alias("size"), "betas").cache()
    points = archive.slope_points(df, ["s", "g"])
    got = binning.packed_bins(df, ["s"], {"frequency": F.lit(1.0), "de": F.col("tau")}, n_bins=7, carry=["g"])
    want = binning.unit_bin_median(binning.unpivot_axes(points, ["s", "g", "beta"], {"frequency": "frequency", "de": "de"}), ["s", "axis"], "g", n_bins=7)
    near(got, want, ["axis", "g", "bin_id"], ["beta_median"])
    assert "hashpartitioning(g" not in plan(got) and "percentile" not in plan(got)
    draws = resampling.boot_cluster(df.drop("s"), df.select("g", F.lit(1).alias("c")), "g", "c", 2, 5, 2, 7)
    near(draws, binning.archive_reduction(points.crossJoin(spark.range(2).select(F.col("id").cast("int").alias("draw"))), ["draw"], "g", 2, n_bins=7), ["draw", "de_bins"], ["raw_variance", "de_variance"])
    assert "percentile(beta" not in plan(draws) and "median(beta" not in plan(draws)
