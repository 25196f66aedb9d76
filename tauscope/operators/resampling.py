"""Bootstraps, permutations and cross-fitting as joins on draw tables.

Draws are rows, not loops. Resampling acts on the small unit-bin table wherever the bins
do not depend on the draw.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tauscope.functions.ranks import cumulative_counts, hash_order, keep, quantiles, rank_columns, same, shuffle_width
from tauscope.functions.rng import hashed, index_draw, uniform
from tauscope.functions.tables import long_form, pick
from tauscope.operators.binning import archive_reduction, bin_variances, dispersion, packed_reduction, unit_bin_median, unpivot_axes
from tauscope.operators.stats import spearman
from tauscope.session import materialise


def each_draw(df: DataFrame, n_draws: int) -> DataFrame:
    return df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))


def bootstrap_weights(units: DataFrame, groups: Sequence[str], unit: str, n_boot: int, seed: int) -> DataFrame:
    """How often each unit is drawn: (groups, draw, unit, weight), zero weights absent."""
    names = keep(units.select(*groups, unit).distinct())
    numbered = keep(hash_order(names, groups, uniform(seed, "order", F.col(unit)), [unit], "_slot"))
    sizes = numbered.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"))
    picks = each_draw(same(numbered, sizes, groups), n_boot).select(
        *groups, "draw", index_draw(F.col("_size"), seed, F.col("draw"), F.col("_slot")).alias("_slot")
    )
    counts = picks.groupBy(*groups, "draw", "_slot").agg(F.count(F.lit(1)).alias("weight"))
    return counts.join(numbered, [*groups, "_slot"]).drop("_slot")


def boot_gauge_reduction(
    binned: DataFrame, groups: Sequence[str], unit: str, n_boot: int, seed: int, min_units: int, sample: bool = False
) -> DataFrame:
    """Reduction per draw with bins kept and drawn units as weights.

    ``sample`` False: population weighted variance, bins need ``min_units`` distinct units.
    ``sample`` True: frequency-weighted sample variance, bins need a total weight of 2.
    """
    binned = keep(binned)
    weights = bootstrap_weights(binned, groups, unit, n_boot, seed)
    w, b = F.col("weight"), F.col("beta_median")
    bins = binned.join(weights, [*groups, unit]).groupBy(*groups, "draw", "axis", "bin_id").agg(
        F.sum(w).alias("_w"), F.sum(w * b).alias("_wb"), F.sum(w * b * b).alias("_wbb"), F.count(F.lit(1)).alias("_units")
    )
    squares = F.col("_wbb") - F.col("_wb") * F.col("_wb") / F.col("_w")
    if sample:
        usable, variance = bins.where(F.col("_w") >= 2), squares / F.greatest(F.col("_w") - 1, F.lit(1))
    else:
        usable, variance = bins.where(F.col("_units") >= min_units), squares / F.col("_w")
    disp = usable.withColumn("_v", variance).groupBy(*groups, "draw", "axis").agg(
        (F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("_var")
    )
    on = lambda axis: F.max(F.when(F.col("axis") == axis, F.col("_var")))
    both = disp.groupBy(*groups, "draw").agg(on("frequency").alias("raw_variance"), on("de").alias("de_variance"))
    return both.withColumn("reduction", F.lit(1.0) - F.col("de_variance") / F.nullif(F.col("raw_variance"), F.lit(0.0)))


def draw_summary(draws: DataFrame, groups: Sequence[str], value: str = "reduction") -> DataFrame:
    """Median, 95 % interval, share above 0 and spread over draws."""
    base = draws.where(F.col(value).isNotNull()).groupBy(*groups).agg(
        F.count(value).alias("n_draws"), F.stddev_samp(value).alias("sd"),
        F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("probability_positive"),
    )
    spread = quantiles(draws, groups, value, {"ci_low": 0.025, "median": 0.5, "ci_high": 0.975})
    return same(base, spread, groups)


def boot_cluster(
    packed: DataFrame, clusters: DataFrame, unit: str, cluster: str, n_boot: int, seed: int, min_units: int, n_bins: int
) -> DataFrame:
    """Resample clusters; a repeated unit counts as another unit and bins are new per draw. ``packed`` (unit, tau, size, betas) has a row per unit."""
    ids = clusters.select(cluster).distinct()
    numbered = hash_order(ids, [], uniform(seed, "order", F.col(cluster)), [cluster], "_slot")
    size = numbered.agg(F.count(F.lit(1)).alias("_size"))
    picks = each_draw(same(numbered, size, []), n_boot).select(
        "draw", F.col("_slot").alias("_rep"), index_draw(F.col("_size"), seed, F.col("draw"), F.col("_slot")).alias("_slot")
    )
    chosen = picks.join(numbered, "_slot").select("draw", "_rep", cluster)
    sample = packed.join(clusters.select(unit, cluster), unit).join(chosen, cluster)
    return packed_reduction(sample.select("draw", "tau", "size", "betas"), ["draw"], min_units, n_bins=n_bins)


def subsample(
    curve: DataFrame, unit: str, k: int, n_draws: int, seed: int, min_units: int, n_bins: int
) -> DataFrame:
    """Reduction of k units drawn without replacement, per draw."""
    units = each_draw(curve.select(unit).distinct(), n_draws)
    order = hash_order(units, ["draw"], uniform(seed, F.col("draw"), F.col(unit)), [unit], "_n")
    kept = order.where(F.col("_n") <= k).select("draw", unit)
    return archive_reduction(curve.join(kept, unit), ["draw"], unit, min_units, n_bins=n_bins)


def permuted(
    units: DataFrame, within: Sequence[str], unit: str, value: str, n_draws: int, seed: int, name: str
) -> DataFrame:
    """Permute ``value`` over units (inside ``within``) once per draw."""
    units = keep(units)
    base = hash_order(units, within, uniform(seed, "order", F.col(unit)), [unit], "_n")
    source = base.select(*within, "_n", F.col(value).alias(name))
    target = hash_order(
        each_draw(units.select(*within, unit), n_draws), [*within, "draw"],
        uniform(seed, F.col("draw"), F.col(unit)), [unit], "_n",
    )
    return target.join(source, [*within, "_n"]).drop("_n")


def random_tau_null(
    curve: DataFrame, unit: str, n_draws: int, seed: int, min_units: int, n_bins: int, within: Sequence[str] = ()
) -> DataFrame:
    """Reduction when memory times are shuffled over units; the raw axis is computed once."""
    taus = curve.groupBy(*within, unit).agg(F.first("tau").alias("tau"))
    shuffled = permuted(taus, list(within), unit, "tau", n_draws, seed, "_tau")
    points = curve.join(shuffled, [*within, unit]).withColumn("de", F.col("frequency") * F.col("_tau"))

    def variance(rows: DataFrame, groups: list[str], column: str) -> DataFrame:
        long = unpivot_axes(rows, [*groups, unit, "beta"], {"a": column})
        keys = [*groups, "axis"]
        stats = bin_variances(unit_bin_median(long, keys, unit, n_bins=n_bins), keys)
        return dispersion(stats, keys, min_units).select(*groups, "weighted_variance")

    raw = variance(curve, [], "frequency").withColumnRenamed("weighted_variance", "raw_variance")
    new = variance(points, ["draw"], "de").withColumnRenamed("weighted_variance", "de_variance")
    return new.crossJoin(raw).withColumn(  # raw is a single row
        "reduction", F.lit(1.0) - F.col("de_variance") / F.nullif(F.col("raw_variance"), F.lit(0.0))
    )


def geo_grid_labels(df: DataFrame, unit: str, lat: str, lon: str, n_lat: int = 3, n_lon: int = 4) -> DataFrame:
    """Cells of a grid cut at equal counts of latitude and longitude order."""
    from tauscope.operators.strata import ordered_number

    placed = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    a = ordered_number(placed.select(unit, lat), unit, lat, "_a").select(unit, "_a")
    b = ordered_number(placed.select(unit, lon), unit, lon, "_b").select(unit, "_b")
    size = placed.agg(F.count(F.lit(1)).alias("_n"))

    def cell(position: str, parts: int) -> Column:
        bins = F.least(F.lit(parts), F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(20.0))))
        share = (F.col(position) - 1) * bins / F.nullif(F.col("_n") - 1, F.lit(0))
        return F.greatest(F.ceil(F.round(share, 9)) - 1, F.lit(0)).cast("int")

    cells = same(a.join(b, unit), size, []).select(
        unit, F.concat_ws("_", cell("_a", n_lat).cast("string"), cell("_b", n_lon).cast("string")).alias("cluster_id")
    )
    return df.select(unit).join(cells, unit, "left").fillna("missing_geo", ["cluster_id"])


def common_buckets(rows: DataFrame, groups: Sequence[str], value: str, name: str, size: int = 4096) -> DataFrame:
    """Attach ``name``: ordered buckets of about ``size`` rows by value; equal values share one.

    All draws of a bootstrap hold the same values, so the order is found once, for all of them.
    """
    cum = cumulative_counts(rows, groups, value).select(*groups, value, F.floor((F.col("_cum") - F.col("_n")) / F.lit(size)).alias(name))
    return rows.join(cum, [*groups, value])


def weighted_ranks(df: DataFrame, by: Sequence[str], value: str, bucket: str, weight: str, name: str) -> DataFrame:
    """Attach ``name``: rank of ``value`` inside ``by`` as if each row stood there ``weight`` times; ties share their mean rank.

    ``{name}_first`` and ``{name}_last`` are the places that the row's equal values take up. Windows run inside a bucket; sums of the buckets
    before it come from a table of one row per bucket.
    """
    inside = W.partitionBy(*by, bucket).orderBy(value)
    upto = F.sum(weight).over(inside.rangeBetween(W.unboundedPreceding, W.currentRow))
    tie = F.sum(weight).over(inside.rangeBetween(W.currentRow, W.currentRow))
    sums = df.groupBy(*by, bucket).agg(F.sum(weight).alias("_size"))
    before = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*by, bucket, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    last = F.col("_before") + F.col("_upto")
    out = df.withColumn("_upto", upto).withColumn("_tie", tie).join(sums, [*by, bucket])
    out = out.withColumn(f"{name}_last", last).withColumn(f"{name}_first", last - F.col("_tie") + 1).withColumn(name, last - (F.col("_tie") - 1) / F.lit(2.0))
    return out.drop("_upto", "_tie", "_before")


def interval(draws: DataFrame, groups: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Percentile interval (2.5 and 97.5) of several columns of a table of draws."""
    long = long_form(draws, groups, names, "_statistic", "_value")
    found = quantiles(long, [*groups, "_statistic"], "_value", {"low": 0.025, "high": 0.975})
    ends = [pick(F.col("_statistic") == n, q).alias(f"{n}_{q}") for n in names for q in ("low", "high")]
    return found.groupBy(*groups).agg(*ends) if groups else found.agg(*ends)


#: Units up to which a draw of a group is taken as one array; larger groups, and groups with several rows per unit, go through ordered buckets.
WHOLE = 1 << 20
#: Draws of one row of work.
DRAW_BLOCK = 100


def packed_draws(rows: DataFrame, groups: Sequence[str], unit: str, columns: Sequence[str], n_boot: int, seed: int, names: Sequence[str], statistic) -> DataFrame:
    """(groups, draw, names): ``statistic`` of the values of drawn units, for every draw of small groups.

    A group's values are one array in the order of their slots, of :data:`WHOLE` units at most. A row of work is a group and a block of draws; it holds the
    numbers of the drawn slots only while it lasts, and the groups of a block share their random numbers, which depend on draw and slot alone.
    ``statistic(*columns)`` prepares a group and returns a function from drawn places to an array.
    """
    slots = hash_order(rows, groups, uniform(seed, "order", F.col(unit)), [unit], "_slot")
    listed = slots.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("_slot", *columns))).alias("_all"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-n_boot // DRAW_BLOCK) - 1))).alias("_block")
    work = materialise(listed).select(*groups, *[F.col("_all")[c].alias(c) for c in columns], F.size("_all").alias("_n"), blocks)
    work = work.repartition(shuffle_width(rows), "_block").sortWithinPartitions("_block", F.desc("_n"))

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def found(block: pd.Series, *values: pd.Series) -> pd.Series:
        out, parts, at, known = [], [], None, []
        for number, *arrays in zip(block, *values):
            n = len(arrays[0])
            if len(parts) < n:
                parts = [b":%d" % i for i in range(1, n + 1)]
            if at != number or (known and len(known[0]) < n):
                at, known = number, []
            take, one = statistic(*arrays), []
            for k in range(min(DRAW_BLOCK, n_boot - number * DRAW_BLOCK)):
                if k == len(known):
                    known.append(hashed(b"%d:%d" % (seed, number * DRAW_BLOCK + k), parts[:n]))
                one.append(take(np.floor(known[k][:n] * n).astype(np.int64)))
            out.append(one)
        return pd.Series(out, dtype=object)

    draws = work.select(*groups, "_block", F.posexplode(found("_block", *columns)).alias("_k", "_f"))
    return draws.select(*groups, (F.col("_block") * DRAW_BLOCK + F.col("_k")).cast("int").alias("draw"), *[F.col("_f")[i].alias(c) for i, c in enumerate(names)])


def all_draws(rows: DataFrame, groups: Sequence[str], unit: str, columns: Sequence[str], names: Sequence[str], n_boot: int, seed: int, statistic, bucketed, whole: int) -> DataFrame:
    """Written draws of all groups: :func:`packed_draws` of those with at most ``whole`` units, ``bucketed`` of the others."""
    kinds = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct(unit).alias("_units"))
    kinds = materialise(kinds.select(*groups, ((F.col("_rows") <= whole) & (F.col("_rows") == F.col("_units"))).alias("_small")))
    of = lambda small: same(rows, kinds.where(F.col("_small") == small).drop("_small"), groups, "left_semi") if groups else rows
    found = {row["_small"] for row in kinds.select("_small").distinct().collect()}  # two values at most
    draws = None
    if True in found:
        draws = packed_draws(of(True), groups, unit, columns, n_boot, seed, names, statistic)
    if False in found or draws is None:
        rest = bucketed(of(False)).select(*groups, "draw", *names)
        draws = rest if draws is None else draws.unionByName(rest)
    return materialise(draws)


def plain_statistics(values: np.ndarray):
    """For :func:`packed_draws`: mean, median and positive share of drawn values."""

    def take(at: np.ndarray) -> np.ndarray:
        v = values[at]
        return np.array([v.mean(), np.median(v), (v > 0).mean()])

    return take


def rank_correlation(x: np.ndarray, y: np.ndarray):
    """For :func:`packed_draws`: rank correlation of drawn pairs, NaN where a side is constant. Values are ordered once; a draw counts them."""
    codes = [np.unique(v, return_inverse=True)[1] for v in (x, y)]

    def take(at: np.ndarray) -> np.ndarray:
        ranks = []
        for code in codes:
            drawn = code[at]
            count = np.bincount(drawn)
            ranks.append((np.cumsum(count) - (count - 1) / 2.0)[drawn] - (len(at) + 1) / 2.0)
        a, b = ranks
        spread = np.sqrt((a @ a) * (b @ b))
        return np.array([a @ b / spread if spread > 0 else np.nan])

    return take


def boot_statistic(df: DataFrame, groups: Sequence[str], unit: str, value: str, n_boot: int, seed: int, whole: int = WHOLE) -> DataFrame:
    """Mean, median and positive share of a value with percentile intervals over resampled units.

    The value may be a paired difference: its median is then the paired median. A group of at most ``whole`` units is drawn from one array, see :func:`packed_draws`.
    """
    rows = keep(df.where(F.col(value).isNotNull()).select(*groups, unit, value))  # read by the order of units and by the draws
    bucketed = lambda some: bucketed_statistics(some, groups, unit, value, n_boot, seed)
    draws = all_draws(rows, groups, unit, [value], ["mean", "median", "positive"], n_boot, seed, plain_statistics, bucketed, whole)
    observed = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("positive"))
    centre = quantiles(rows, groups, value, {"median": 0.5})
    return same(same(observed, centre, groups), interval(draws, groups, ["mean", "median", "positive"]), groups)


def bucketed_statistics(rows: DataFrame, groups: Sequence[str], unit: str, value: str, n_boot: int, seed: int) -> DataFrame:
    """Draws of :func:`boot_statistic` without a group in one task: draws are weights on units, and the median of a draw is read off its weighted order statistics."""
    weights = bootstrap_weights(rows, groups, unit, n_boot, seed)
    by = [*groups, "draw"]
    ranked = weighted_ranks(common_buckets(rows, groups, value, "_bucket").join(weights, [*groups, unit]), by, value, "_bucket", "weight", "_r")
    sizes = ranked.groupBy(*by).agg(
        F.sum("weight").alias("_n"), (F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias("mean"),
        (F.sum(F.when(F.col(value) > 0, F.col("weight")).otherwise(0)) / F.sum("weight")).alias("positive"),
    )
    at = lambda place: F.max(F.when((F.col("_r_first") <= place) & (F.col("_r_last") >= place), F.col(value)))
    low, high = F.floor((F.col("_n") + 1) / 2), F.ceil((F.col("_n") + 1) / F.lit(2))
    middle = ranked.join(sizes, by).groupBy(*by, "mean", "positive").agg(at(low).alias("_a"), at(high).alias("_b"))
    return middle.select(*by, "mean", "positive", ((F.col("_a") + F.col("_b")) / 2).alias("median"))


def boot_rho(df: DataFrame, groups: Sequence[str], unit: str, x: str, y: str, n_boot: int, seed: int, min_n: int = 8, whole: int = WHOLE) -> DataFrame:
    """Rank correlation with the median and percentile interval over resampled units; groups under ``min_n`` pairs drop out.

    Draws with a constant side have no correlation and are left out. A group of at most ``whole`` units is drawn from one array, see :func:`packed_draws`.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*groups, unit, F.col(x).alias("_x"), F.col(y).alias("_y"))
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_pairs")).where(F.col("_pairs") >= min_n)
    rows = keep(same(rows, sizes, groups).drop("_pairs"))
    bucketed = lambda some: bucketed_rhos(some, groups, unit, n_boot, seed)
    draws = all_draws(rows, groups, unit, ["_x", "_y"], ["rho"], n_boot, seed, rank_correlation, bucketed, whole)
    found = quantiles(draws, groups, "rho", {"rho_boot_median": 0.5, "rho_low": 0.025, "rho_high": 0.975})
    return same(spearman(rows, groups, "_x", "_y", min_n), found, groups)


def bucketed_rhos(rows: DataFrame, groups: Sequence[str], unit: str, n_boot: int, seed: int) -> DataFrame:
    """Draws of :func:`boot_rho` without a group in one task: ranks inside a draw are weighted ranks of the drawn units."""
    placed = common_buckets(common_buckets(rows, groups, "_x", "_bx"), groups, "_y", "_by")
    by = [*groups, "draw"]
    drawn = placed.join(bootstrap_weights(rows, groups, unit, n_boot, seed), [*groups, unit])
    ranked = weighted_ranks(weighted_ranks(drawn, by, "_x", "_bx", "weight", "_rx"), by, "_y", "_by", "weight", "_ry")
    w = F.col("weight")
    sums = ranked.groupBy(*by).agg(
        F.sum(w).alias("_n"), F.sum(w * F.col("_rx") * F.col("_ry")).alias("_xy"), F.sum(w * F.col("_rx") * F.col("_rx")).alias("_xx"), F.sum(w * F.col("_ry") * F.col("_ry")).alias("_yy"))
    centre = F.col("_n") * F.pow((F.col("_n") + 1) / F.lit(2.0), F.lit(2.0))
    spread = F.sqrt((F.col("_xx") - centre) * (F.col("_yy") - centre))
    return sums.select(*by, ((F.col("_xy") - centre) / F.nullif(spread, F.lit(0.0))).alias("rho"))


@F.pandas_udf(T.DoubleType())
def partial_from_sums(gram: pd.Series, sums: pd.Series, square: pd.Series) -> pd.Series:
    """Partial correlation of x and a permuted y: sums are its products with (x, controls), gram is theirs, flat, zeros where a set has no column."""
    out, solved = [], {}
    for flat, own, yy in zip(gram, sums, square):
        size, own = len(own), np.asarray(own, dtype=float)
        key = np.asarray(flat, dtype=float).tobytes()
        if key not in solved:
            g = np.frombuffer(key).reshape(size, size)
            inverse = np.linalg.pinv(g[1:, 1:], rcond=1e-12) if size > 1 else np.zeros((0, 0))
            solved[key] = inverse, inverse @ g[1:, 0], g[0, 0] - g[0, 1:] @ inverse @ g[1:, 0]
        inverse, w, xx = solved[key]
        rest = yy - own[1:] @ inverse @ own[1:]
        whole = xx * rest
        out.append((own[0] - w @ own[1:]) / whole**0.5 if xx > 1e-9 and rest > 1e-9 else None)
    return pd.Series(out, dtype="float64")


def control_grams(df: DataFrame, unit: str, x: str, y: str, sets: Mapping[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """Centred ranks as vectors per control set and unit, and per set the Gram matrix with the observed partial rank correlation.

    A set uses the units that have all of its columns. All columns of all sets are ranked in one pass, in long form. The vector
    is (x, every control), 0 where a set has no such column; y stands apart.
    """
    columns = list(dict.fromkeys(c for cs in sets.values() for c in cs))
    every = [x, *columns, y]

    def usable(cs: Sequence[str]) -> Column:
        ok = F.lit(True)
        for c in (x, y, *cs):
            ok = ok & F.col(c).isNotNull()
        return ok

    member = F.array(*[F.struct(F.lit(n).alias("controls"), usable(cs).alias("_in"), F.array(*[F.lit(c) for c in (x, *cs, y)]).alias("_used")) for n, cs in sets.items()])
    rows = df.select(unit, *every, F.inline(member)).where("_in")
    long = long_form(rows, ["controls", unit, "_used"], every, "_column", "_value")
    long = keep(long.where(F.array_contains("_used", F.col("_column"))).select("controls", unit, "_column", "_value"))
    ranked = rank_columns(long, ["controls", "_column"], ["_value"], centred=True)
    of = lambda c: F.coalesce(pick(F.col("_column") == c, "_r__value"), F.lit(0.0))
    vectors = keep(ranked.groupBy("controls", unit).agg(F.array(*[of(c) for c in (x, *columns)]).alias("_v"), of(y).alias("_y")))
    k = len(columns) + 1
    v = lambda i: F.col("_v")[i]
    gram = vectors.groupBy("controls").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(v(min(i, j)) * v(max(i, j))) for i in range(k) for j in range(k)]).alias("_gram"),
        F.array(*[F.sum(v(i) * F.col("_y")) for i in range(k)]).alias("_own"), F.sum(F.col("_y") * F.col("_y")).alias("_square"))
    return vectors, keep(gram.withColumn("partial_rho", partial_from_sums("_gram", "_own", "_square")))


def perm_partial(df: DataFrame, unit: str, x: str, y: str, sets: Mapping[str, Sequence[str]], n_draws: int, seed: int) -> DataFrame:
    """Partial rank correlation of x and y under several control sets with two-sided permutation p, (k + 1) / (n + 1).

    Ranks are taken once: permuting y permutes its ranks. The products of a draw's permuted y with x and the controls are one
    aggregation; a partial correlation follows from them and the set's Gram matrix, so no draw is ranked or regressed again.
    """
    vectors, gram = control_grams(df, unit, x, y, sets)
    k = len(set().union(*sets.values())) + 1
    moved = permuted(vectors.select("controls", unit, "_y"), ["controls"], unit, "_y", n_draws, seed, "_p").join(vectors.select("controls", unit, "_v"), ["controls", unit])
    sums = moved.groupBy("controls", "draw").agg(F.array(*[F.sum(F.col("_v")[i] * F.col("_p")) for i in range(k)]).alias("_sums"))
    draws = sums.join(gram, "controls").withColumn("_r", partial_from_sums("_gram", "_sums", "_square"))
    hit = F.sum(F.when(F.abs("_r") >= F.abs("partial_rho") - 1e-12, 1).otherwise(0))
    return draws.where(F.col("_r").isNotNull()).groupBy("controls", "n", "partial_rho").agg(
        F.count(F.lit(1)).alias("n_perm"), ((hit + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def perm_correlation(df: DataFrame, unit: str, x: str, y: str, n_draws: int, seed: int) -> DataFrame:
    """Two-sided permutation p of a correlation, (k + 1) / (n + 1), and z of r squared."""
    from tauscope.functions.expressions import guarded_corr

    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(unit, x, y)
    observed = rows.agg(guarded_corr(x, y).alias("observed"))
    shuffled = permuted(rows.select(unit, x), [], unit, x, n_draws, seed, "_x").join(rows.select(unit, y), unit)
    draws = shuffled.groupBy("draw").agg(guarded_corr("_x", y).alias("_r")).crossJoin(observed)  # single row
    r2 = F.col("_r") * F.col("_r")
    return draws.groupBy("observed").agg(
        ((F.sum(F.when(F.abs("_r") >= F.abs("observed"), 1).otherwise(0)) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"),
        F.avg(r2).alias("null_r2"), F.stddev_samp(r2).alias("null_r2_sd"), F.count(F.lit(1)).alias("n_draws"),
    ).withColumn(
        "z", (F.col("observed") * F.col("observed") - F.col("null_r2")) / F.nullif(F.col("null_r2_sd"), F.lit(0.0))
    )


def variance_partition(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """R squared of y on every subset of a few predictors, and the share that belongs to the subset alone.

    All regressions come from one covariance matrix, aggregated once over the rows that have all columns. ``unique_share`` of a
    subset is what only its members together explain: the alternating sum over its parts of what is lost without them (for two predictors
    a and b: R2(ab) - R2(b), R2(ab) - R2(a), and the common part R2(a) + R2(b) - R2(ab)). The shares add up to the R squared of all.
    """
    columns = [y, *xs]
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    cov = rows.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.covar_pop(a, b) for a in columns for b in columns]).alias("_cov"))
    k = len(xs)
    names = ["+".join(x for i, x in enumerate(xs) if m >> i & 1) for m in range(1, 1 << k)]

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def explained(flat: pd.Series) -> pd.Series:
        out = []
        for values in flat:
            c = np.asarray(values, dtype=float).reshape(k + 1, k + 1)
            r2 = [0.0]
            for m in range(1, 1 << k):
                use = [i + 1 for i in range(k) if m >> i & 1]
                r2.append(float(c[0, use] @ np.linalg.pinv(c[np.ix_(use, use)], rcond=1e-12) @ c[use, 0] / c[0, 0]) if c[0, 0] > 0 else float("nan"))
            full = (1 << k) - 1
            own = []
            for m in range(1, 1 << k):  # inclusion and exclusion over the parts of m
                parts = [p for p in range(m + 1) if p & m == p]
                own.append(sum((-1) ** (bin(p).count("1") + 1) * r2[full & ~m | p] for p in parts))
            out.append([r2[1:], own])
        return pd.Series(out)

    found = cov.select("n", explained("_cov").alias("_e"))
    zipped = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("subset"), F.col("_e")[0].alias("r2"), F.col("_e")[1].alias("unique_share"))
    return found.select("n", F.inline(zipped)).select(F.col("subset"), "n", "r2", "unique_share")


def crossfit_tau(segment_tau: DataFrame, keys: Sequence[str], segment: str) -> DataFrame:
    """For every segment the median memory time of the gauge's other segments; with two of them this is the opposite half.

    A gauge has a handful of segments: they become one sorted list, from which each segment leaves out itself.
    """
    listed = segment_tau.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("tau").alias("t"), F.col(segment).alias("s")))).alias("_all"))
    one = listed.select(*keys, "_all", F.explode("_all").alias("_own")).select(
        *keys, F.col("_own.s").alias(segment), F.transform(F.filter("_all", lambda o: o["s"] != F.col("_own.s")), lambda o: o["t"]).alias("_t"))
    size = F.size("_t")
    low, high = F.floor((size - 1) / 2).cast("int"), F.floor(size / 2).cast("int")
    return one.where(size > 0).select(*keys, segment, ((F.get("_t", low) + F.get("_t", high)) / 2).alias("tau"))


def kfold_distance(binned: DataFrame, groups: Sequence[str], unit: str, folds: int, seed: int, min_train: int) -> DataFrame:
    """Distance of held-out units to the bin medians of the other folds."""
    fold = F.floor(uniform(seed, F.col(unit)) * F.lit(float(folds))).cast("int")
    work = binned.withColumn("fold", fold)
    train = work.withColumn("_test", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where(F.col("fold") != F.col("_test"))
    keys = [*groups, "_test", "bin_id"]
    ref = quantiles(train, keys, "beta_median", {"_mid": 0.5}).join(
        train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_train), keys
    ).withColumnRenamed("_test", "fold")
    gap = F.abs(F.col("beta_median") - F.col("_mid"))
    return work.join(ref, [*groups, "fold", "bin_id"]).groupBy(*groups, "fold").agg(
        F.avg(gap).alias("mean_abs_distance"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.count(F.lit(1)).alias("n_values")
    )
