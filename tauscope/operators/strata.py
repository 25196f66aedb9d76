"""Strata, alternative coordinates and side-by-side comparisons of reductions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tauscope.functions.expressions import guarded_corr
from tauscope.functions.ranks import average_ranks, quantiles, rank_columns, same
from tauscope.operators.binning import archive_reduction


def beta_families(curve: DataFrame, reference: str = "ar1") -> DataFrame:
    """Observed, reference and residual slopes as three families in one table."""
    part = lambda name, value: F.struct(F.lit(name).alias("family"), value.alias("beta"))
    b, ref = F.col("beta"), F.col(reference)
    families = F.array(part("observed", b), part("reference", ref), part("residual", b - ref))
    return curve.select("gauge_id", "frequency", "de", F.inline(families)).where(F.col("beta").isNotNull())


def alternative_axis(curve: DataFrame, coordinate: Column) -> DataFrame:
    """Replace the memory time by another coordinate on the same points."""
    return curve.where(coordinate > 0).withColumn("de", F.col("frequency") * coordinate)


def ordered_number(df: DataFrame, unit: str, value: str, name: str) -> DataFrame:
    """Number units 1..n by (value, unit) without one global sort.

    The average-rank machinery places the distinct values; ties are numbered by unit id
    inside one value.
    """
    from pyspark.sql import Window as W

    ranked = average_ranks(df, [], value, "_rank")
    ties = W.partitionBy(value)
    first = F.col("_rank") - (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
    return ranked.withColumn(name, (first + F.row_number().over(ties.orderBy(unit)) - 1).cast("long")).drop("_rank")


def rank_matched(df: DataFrame, unit: str, tau: str, proxy: str) -> DataFrame:
    """Give the sorted memory times to the units in proxy order."""
    by_tau = ordered_number(df.select(unit, tau), unit, tau, "_n").select("_n", F.col(tau).alias("proxy_tau"))
    by_proxy = ordered_number(df.select(unit, proxy), unit, proxy, "_n").select("_n", unit)
    return by_proxy.join(by_tau, "_n").drop("_n")


def tercile(df: DataFrame, attribute: str) -> DataFrame:
    edges = quantiles(df, [], attribute, {"_a": 1.0 / 3.0, "_b": 2.0 / 3.0})
    label = (
        F.when(F.col(attribute) <= F.col("_a"), "low").when(F.col(attribute) <= F.col("_b"), "middle").otherwise("high")
    )
    return same(df.where(F.col(attribute).isNotNull()), edges, []).withColumn("stratum", label).drop("_a", "_b")


def quartile_summary(df: DataFrame, attribute: str, value: str) -> DataFrame:
    """Size, median, positive share and quartiles of a value per quartile of an attribute."""
    edges = quantiles(df, [], attribute, {"_a": 0.25, "_b": 0.5, "_c": 0.75})
    x = F.col(attribute)
    label = F.when(x <= F.col("_a"), 1).when(x <= F.col("_b"), 2).when(x <= F.col("_c"), 3).otherwise(4)
    work = same(df, edges, []).withColumn("quartile", label)
    base = work.groupBy("quartile").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("positive_share")
    )
    spread = quantiles(work, ["quartile"], value, {"q25": 0.25, "median_reduction": 0.5, "q75": 0.75})
    return base.join(spread, "quartile")


def slow_memory(curve: DataFrame, unit: str, limits: Sequence[int], min_units: int, n_bins: int) -> DataFrame:
    """Reduction among units whose memory time is at most each limit."""
    limit = F.explode(F.array(*[F.lit(t) for t in limits]))
    work = curve.withColumn("tau_limit", limit).where(F.col("tau") <= F.col("tau_limit"))
    return archive_reduction(work, ["tau_limit"], unit, min_units, n_bins=n_bins)


def forcing_contrast(flow: DataFrame, forcing: DataFrame, keys: Sequence[str], min_units: int, n_bins: int) -> DataFrame:
    """Join flow and forcing curves on the exact DFT index and reduce their slope difference."""
    other = forcing.select(*keys, "k", F.col("beta").alias("_beta_p"), F.col("tau").alias("tau_p"))
    both = flow.join(other, [*keys, "k"]).withColumn("contrast", F.col("beta") - F.col("_beta_p"))
    both = both.withColumn("de_p", F.col("frequency") * F.col("tau_p"))
    parts = []
    for name, axis in (("de_flow", "de"), ("de_forcing", "de_p")):
        red = archive_reduction(
            both.withColumn("_axis", F.lit(name)), ["_axis"], "gauge_id", min_units,
            {"frequency": "frequency", "de": axis}, n_bins=n_bins, beta="contrast",
        )
        parts.append(red.withColumnRenamed("_axis", "coordinate"))
    return parts[0].unionByName(parts[1])


def construct_rank(curve: DataFrame) -> DataFrame:
    """Rank correlations among frequency, memory time, de and slope over all points."""
    columns = ["frequency", "tau", "de", "beta"]
    work = rank_columns(curve.select(columns), [], columns)
    rho = lambda a, b: guarded_corr(f"_r_{a}", f"_r_{b}")
    return work.agg(
        F.count(F.lit(1)).alias("n"), rho("frequency", "beta").alias("rho_frequency_beta"),
        rho("tau", "beta").alias("rho_tau_beta"), rho("de", "beta").alias("rho_de_beta"),
        rho("frequency", "de").alias("rho_frequency_de"),
    )


def compare(table: DataFrame, pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Set a group's value beside a comparison group's value."""
    a = table.select(F.col(key).alias("scenario"), F.col(value).alias("_a"))
    b = table.select(F.col(key).alias("comparison"), F.col(value).alias("_b"))
    return pairs.join(a, "scenario").join(b, "comparison").select(
        "scenario", "comparison", (F.col("_a") - F.col("_b")).alias("difference")
    )
