"""Rank statistics, multiple testing and concentration-discharge relations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tauscope.functions.expressions import guarded_corr
from tauscope.functions.pvalues import correlation_p, normal_p, regularised_beta
from tauscope.functions.ranks import cumulative_counts, keep, quantiles, rank_columns, same, shuffle_width, suffix_min
from tauscope.functions.tables import long_form
from tauscope.session import materialise


def spearman(df: DataFrame, groups: Sequence[str], x: str, y: str, min_n: int = 3) -> DataFrame:
    """Rank correlation of complete pairs per group, null when a side is constant."""
    present = F.col(x).isNotNull() & F.col(y).isNotNull()
    pairs = df.where(present).groupBy(*groups, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_copies"))
    ranked = rank_columns(keep(pairs), groups, ["_x", "_y"], weight="_copies", centred=True)
    # ranks are centred on their exact mean, so a constant side sums to exactly 0
    moment = lambda a, b: F.sum(F.col("_copies") * F.col(f"_r__{a}") * F.col(f"_r__{b}"))
    rho = moment("x", "y") / F.nullif(F.sqrt(moment("x", "x")) * F.sqrt(moment("y", "y")), F.lit(0.0))
    out = ranked.groupBy(*groups).agg(F.sum("_copies").alias("n"), rho.alias("rho"))
    return out.where(F.col("n") >= min_n)


def attribute_spearman(df: DataFrame, attributes: Sequence[str], target: str, min_n: int = 10) -> DataFrame:
    """Every attribute against one target, with t-based p and BH-adjusted q."""
    # written: one row per attribute, so that the plan of the adjustment does not hold the ranks many times over
    rows = materialise(attribute_rhos(df, attributes, target, min_n))
    return bh_fdr(rows.withColumn("p_value", correlation_p("rho", "n")), [], "p_value", "attribute")


def attribute_rhos(df: DataFrame, attributes: Sequence[str], target: str, min_n: int = 10) -> DataFrame:
    """Rank correlation of every attribute with one target: (attribute, n, rho)."""
    return spearman(long_form(df, [target], attributes, "attribute", "_value"), ["attribute"], "_value", target, min_n).select("attribute", "n", "rho")


def bh_fdr(df: DataFrame, groups: Sequence[str], p: str, tie: str, null_as_one: bool = False) -> DataFrame:
    """Benjamini-Hochberg q per group: the smallest p m / rank at or above each p.

    Tests with one p share the rank of the last of them, so the work is on counted p values: ranks from ordered buckets,
    then the minimum over the values at or above by buckets too. No window holds the tests of a family. ``tie`` is kept for callers
    that name an order; q does not depend on it.
    """
    value = F.coalesce(F.col(p), F.lit(1.0)) if null_as_one else F.col(p)
    family = ["_family"] if groups else []
    # a struct of keys equals another one with the same nulls
    work = keep(df.withColumn("_p", value).withColumn("_family", F.struct(*groups) if groups else F.lit(0)))
    counts = cumulative_counts(work, family, "_p")
    raw = counts.withColumn("_raw", F.col("_p") * F.col("_total") / F.col("_cum"))
    bucket = F.floor((F.col("_cum") - 1) * F.lit(float(shuffle_width(df))) / F.col("_total"))
    least = suffix_min(raw, family, "_p", "_raw", bucket, "_q").select(*family, "_p", F.least(F.lit(1.0), F.col("_q")).alias("q_value"))
    return work.join(least, [*family, "_p"], "left").select(*df.columns, "q_value")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def residual_weights(cov: pd.Series) -> pd.Series:
    """Least-squares weights of x and y on the controls from one flat covariance matrix."""
    out = []
    for flat in cov:
        size = int(round(len(flat) ** 0.5))
        matrix = np.asarray(flat, dtype=float).reshape(size, size)
        if size == 2:
            out.append([])
        else:
            out.append(np.linalg.lstsq(matrix[2:, 2:], matrix[2:, :2], rcond=None)[0].T.ravel())
    return pd.Series(out)


def partial_spearman(df: DataFrame, x: str, y: str, controls: Sequence[str], by_rank: bool = False) -> DataFrame:
    """Rank correlation of x and y after removing ranked controls by least squares.

    Only one row, the covariance matrix of the ranked columns, is solved outside Spark
    SQL. ``by_rank`` correlates the ranks of the residuals instead of the residuals.
    """
    columns = [x, y, *controls]
    present = F.lit(True)
    for c in columns:
        present = present & F.col(c).isNotNull()
    ranked = keep(df.where(present).select(*columns))
    ranked = rank_columns(ranked, [], columns)
    names = [f"_r_{c}" for c in columns]
    ranked = materialise(ranked.select(*names))
    moments = ranked.agg(
        F.array(*[F.avg(c) for c in names]).alias("_mean"),
        F.array(*[F.covar_pop(a, b) for a in names for b in names]).alias("_cov"),
    ).select("_mean", residual_weights("_cov").alias("_w"))
    k = len(controls)
    centred = lambda i: F.col(names[i]) - F.col("_mean")[i]

    def residual(side: int) -> Column:
        out = centred(side)
        for j in range(k):
            out = out - F.col("_w")[side * k + j] * centred(2 + j)
        return F.round(out, 9)

    work = same(ranked, moments, []).select(residual(0).alias("_a"), residual(1).alias("_b"))
    if by_rank:
        work = materialise(work)
        work = rank_columns(work, [], ["_a", "_b"])
        work = work.select(F.col("_r__a").alias("_a"), F.col("_r__b").alias("_b"))
    return work.agg(F.count(F.lit(1)).alias("n"), guarded_corr("_a", "_b").alias("partial_rho"))


def control_ladder(df: DataFrame, x: str, y: str, ladders: Mapping[str, Sequence[str]]) -> DataFrame:
    """The same pair under several control sets, one row each."""
    df = keep(df.select(*dict.fromkeys([x, y, *[c for cs in ladders.values() for c in cs]])))
    out = None
    for name, controls in ladders.items():
        row = partial_spearman(df, x, y, controls).withColumn("controls", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def wilcoxon(df: DataFrame, groups: Sequence[str], delta: str) -> DataFrame:
    """Signed-rank statistic min(W+, W-), zeros dropped; normal p with tie correction."""
    side = lambda sign: F.count(F.when(sign, 1))
    counted = df.where(F.col(delta).isNotNull() & (F.col(delta) != 0)).groupBy(*groups, F.round(F.abs(delta), 12).alias("_a"))
    counted = counted.agg(F.count(F.lit(1)).alias("_t"), side(F.col(delta) > 0).alias("_plus"), side(F.col(delta) < 0).alias("_minus"))
    ranked = rank_columns(keep(counted), groups, ["_a"], weight="_t")
    sums = ranked.groupBy(*groups).agg(
        F.sum("_t").alias("n"),
        F.sum(F.col("_plus") * F.col("_r__a")).alias("w_plus"),
        F.sum(F.col("_minus") * F.col("_r__a")).alias("w_minus"),
        F.sum(F.pow("_t", F.lit(3.0)) - F.col("_t")).alias("_ties"),
    )
    n = F.col("n")
    variance = n * (n + 1) * (2 * n + 1) / F.lit(24.0) - F.col("_ties") / F.lit(48.0)
    z = (F.col("w_plus") - n * (n + 1) / F.lit(4.0)) / F.nullif(F.sqrt(variance), F.lit(0.0))
    return (
        sums.withColumn("z", z)
        .withColumn("statistic", F.least("w_plus", "w_minus"))
        .drop("_ties")
        .withColumn("p_value", normal_p("z"))
    )


def binomial_less(df: DataFrame, groups: Sequence[str], success: Column, chance: float = 0.5) -> DataFrame:
    """P(X <= k) for k successes of n: the regularised incomplete beta function at (n - k, k + 1)."""
    base = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(success, 1)).alias("k"))
    below = regularised_beta(F.greatest(F.col("n") - F.col("k"), F.lit(1)), F.col("k") + 1, F.lit(1.0 - chance))
    return base.withColumn("p_less", F.when(F.col("k") >= F.col("n"), 1.0).otherwise(F.least(F.lit(1.0), below)))


def kendall_ranks(df: DataFrame, unit: str, model: str, score: str, distance: str, min_models: int = 3) -> DataFrame:
    """Tau-b per unit between score rank and distance rank over its models, and both best models.

    A unit has one row per model, so the self-join stays at a few pairs per unit.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(distance).isNotNull()).select(unit, model, score, distance)
    left = rows.select(unit, F.col(model).alias("_m"), F.col(score).alias("_s"), F.col(distance).alias("_d"))
    pairs = rows.join(left, unit).where(F.col(model) < F.col("_m"))
    a, b = -F.signum(F.col(score) - F.col("_s")), F.signum(F.col(distance) - F.col("_d"))
    tau = pairs.groupBy(unit).agg(
        (F.sum(a * b) / F.nullif(F.sqrt(F.sum(F.abs(a)) * F.sum(F.abs(b))), F.lit(0.0))).alias("kendall_tau")
    )
    best = rows.groupBy(unit).agg(
        F.count(F.lit(1)).alias("n_models"),
        F.min_by(model, F.struct(-F.col(score), F.col(model))).alias("best_by_score"),
        F.min_by(model, F.struct(F.col(distance), F.col(model))).alias("best_by_distance"),
    )
    return best.where(F.col("n_models") >= min_models).join(tau, unit)


def logit_per_sd(df: DataFrame, predictors: Sequence[str], outcome: str, steps: int = 25) -> DataFrame:
    """One-predictor logistic fits on standardised predictors, all of them in the same Newton steps.

    A step is one aggregation of gradient and curvature over all rows and predictors, solved in closed form (two unknowns per
    predictor); it ends when no coefficient moves by more than 1e-10. A predictor that is constant, or whose
    classes it separates (the curvature vanishes), has null results.
    """
    long = long_form(df, [outcome], predictors, "predictor", "_v").where(F.col("_v").isNotNull() & F.col(outcome).isNotNull())
    moments = long.groupBy("predictor").agg(F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_s"), F.count(F.lit(1)).alias("n"))
    rows = long.join(moments, "predictor").where(F.col("_s") > 0)
    rows = keep(rows.select("predictor", "n", ((F.col("_v") - F.col("_m")) / F.col("_s")).alias("_z"), F.col(outcome).cast("double").alias("_y")))
    fits, sums = {name: (0.0, 0.0) for name in predictors}, {}
    for _ in range(steps):
        at = lambda i: F.element_at(F.create_map(*[F.lit(v) for n, w in fits.items() for v in (n, w[i])]), F.col("predictor"))  # noqa: E731, B023
        scored = rows.withColumn("_mu", 1 / (1 + F.exp(-(at(0) + at(1) * F.col("_z")))))
        weight, gap = F.col("_mu") * (1 - F.col("_mu")), F.col("_y") - F.col("_mu")
        found = scored.groupBy("predictor").agg(
            F.first("n").alias("n"), F.sum(gap).alias("g0"), F.sum(gap * F.col("_z")).alias("g1"), F.sum(weight).alias("h00"),
            F.sum(weight * F.col("_z")).alias("h01"), F.sum(weight * F.col("_z") * F.col("_z")).alias("h11"),
        ).collect()  # one row per predictor
        moved = 0.0
        for r in found:
            det = r.h00 * r.h11 - r.h01 * r.h01
            if det <= 1e-12 * r.h00 * r.h11 or r.h00 < 1e-8 * r.n:
                sums.pop(r.predictor, None)
                continue
            up = ((r.h11 * r.g0 - r.h01 * r.g1) / det, (r.h00 * r.g1 - r.h01 * r.g0) / det)
            fits[r.predictor] = (fits[r.predictor][0] + up[0], fits[r.predictor][1] + up[1])
            sums[r.predictor] = (int(r.n), (r.h00 / det) ** 0.5)
            moved = max(moved, abs(up[0]), abs(up[1]))
        if moved < 1e-10:
            break
    table = [(n, sums[n][0], fits[n][1], sums[n][1]) if n in sums else (n, None, None, None) for n in predictors]
    out = df.sparkSession.createDataFrame(table, "predictor string, n int, coefficient double, std_error double")
    out = out.withColumn("p_value", normal_p(F.col("coefficient") / F.col("std_error")))
    half = F.lit(1.959963984540054) * F.col("std_error")
    out = out.withColumn("odds_ratio", F.exp("coefficient")).withColumn("or_low", F.exp(F.col("coefficient") - half))
    return bh_fdr(out.withColumn("or_high", F.exp(F.col("coefficient") + half)), [], "p_value", "predictor")


def cq_relation(samples: DataFrame, min_samples: int = 30, min_years: float = 5.0) -> DataFrame:
    """Log-log slope, r2, rank correlation and spread ratio per gauge and constituent."""
    keys = ["gauge_id", "constituent"]
    rows = samples.where((F.col("q_use") > 0) & (F.col("concentration") > 0)).select(
        *keys, "sample_date", "q_use", "concentration", F.log("q_use").alias("_q"), F.log("concentration").alias("_c")
    )
    # a pair of gauge and constituent holds few samples, so it is ranked inside one window; the logarithm keeps order
    for c in ("q_use", "concentration"):
        ties = F.count(F.lit(1)).over(W.partitionBy(*keys, c))
        rows = rows.withColumn(f"_r_{c}", F.rank().over(W.partitionBy(*keys).orderBy(c)) + (ties - 1) / F.lit(2.0))
    days = F.datediff(F.max("sample_date"), F.min("sample_date"))
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), (days / F.lit(365.25)).alias("span_years"),
        F.stddev_samp("_q").alias("sd_log_discharge"), F.stddev_samp("_c").alias("sd_log_concentration"),
        F.covar_samp("_q", "_c").alias("_cov"), guarded_corr("_r_q_use", "_r_concentration").alias("cq_spearman"),
    ).where(
        (F.col("n_samples") >= min_samples) & (F.col("span_years") >= min_years)
        & (F.col("sd_log_discharge") > 0) & (F.col("sd_log_concentration") > 0)
    )
    r = F.col("_cov") / (F.col("sd_log_discharge") * F.col("sd_log_concentration"))
    out = base.withColumn("cq_slope", F.col("_cov") / (F.col("sd_log_discharge") * F.col("sd_log_discharge")))
    out = out.withColumn("cq_r2", r * r).withColumn("chem_variability_ratio", F.col("sd_log_concentration") / F.col("sd_log_discharge"))
    return out.select(*[c for c in out.columns if c not in ("_cov", "cq_spearman")], "cq_spearman")


def cq_gauge(pairs: DataFrame, sets: Mapping[str, Sequence[str]], summary: DataFrame, min_constituents: int = 3) -> DataFrame:
    """Medians over constituent sets per gauge (few rows each), joined to the gauge summary."""
    member = F.array(*[
        F.struct(F.lit(n).alias("aggregation"), F.col("constituent").isin(list(c)).alias("_in")) for n, c in sets.items()
    ])
    rows = pairs.select("*", F.inline(member)).where("_in")
    med = lambda c, name: F.median(c).alias(name)
    agg = rows.groupBy("gauge_id", "aggregation").agg(
        F.count_distinct("constituent").alias("n_constituents"), med("n_samples", "median_samples"),
        F.max("span_years").alias("max_span_years"), med("chem_variability_ratio", "median_damping"),
        med(F.abs("cq_slope"), "median_abs_slope"), med("cq_spearman", "median_spearman"), med("cq_r2", "median_r2"),
    )
    return agg.where(F.col("n_constituents") >= min_constituents).join(summary, "gauge_id")


def tracer_damping(samples: DataFrame, variable: str, min_n: int = 10) -> DataFrame:
    """Spread of stream samples relative to the input samples of the same cadence."""
    rows = samples.where(F.col(variable).isNotNull()).withColumn("_kind", F.lower("type"))
    spread = {"q25": 0.25, "q75": 0.75}

    def side(kind: str, keys: list[str], prefix: str) -> DataFrame:
        own = rows.where(F.col("_kind") == kind)
        base = own.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{prefix}"), F.stddev_samp(variable).alias(f"{prefix}_sd"))
        q = quantiles(own, keys, variable, spread).select(*keys, (F.col("q75") - F.col("q25")).alias(f"{prefix}_iqr"))
        return base.where(F.col(f"n_{prefix}") >= min_n).join(q, keys)

    both = side("stream", ["cadence", "site"], "stream").join(side("input", ["cadence"], "input"), "cadence")
    return both.withColumn(
        "sd_ratio", F.col("stream_sd") / F.nullif(F.col("input_sd"), F.lit(0.0))
    ).withColumn("iqr_ratio", F.col("stream_iqr") / F.nullif(F.col("input_iqr"), F.lit(0.0)))
