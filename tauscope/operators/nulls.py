"""Null series as joins on hashed row numbers: white, seasonal, block and water-year draws; draws are rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tauscope.functions.rng import hashed, index_draw, normal, uniform
from tauscope.operators.prep import DOUBLES, anomaly_of, once, per_series, season_key, water_year
from tauscope.operators.resampling import each_draw
from tauscope.operators.spectral import curve_columns, curve_of


def rescale(df: DataFrame, keys: Sequence[str], value: str, mean: Column, std: Column) -> DataFrame:
    """Give each null series the mean and population deviation of its original."""
    series = W.partitionBy(*keys)
    own = F.nullif(F.stddev_pop(value).over(series), F.lit(0.0))
    return df.withColumn(value, F.coalesce((F.col(value) - F.avg(value).over(series)) / own * std + mean, mean))


def with_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    series = W.partitionBy(*keys)
    return (
        df.withColumn("_mean", F.avg(value).over(series))
        .withColumn("_std", F.stddev_pop(value).over(series))
        .withColumn("_n", F.count(F.lit(1)).over(series))
    )


def white(df: DataFrame, keys: Sequence[str], index: str, value: str, n_draws: int, seed: int) -> DataFrame:
    work = each_draw(with_moments(df, keys, value), n_draws)
    noise = normal(seed, F.col("draw"), *[F.col(k) for k in keys], F.col(index))
    return work.select(*keys, "draw", index, (F.col("_mean") + F.col("_std") * noise).alias("x"))


def ar1_fit(df: DataFrame, keys: Sequence[str], index: str, value: str) -> DataFrame:
    """Lag-one regression through the origin (clipped at 0.99) and residual deviation."""
    series = W.partitionBy(*keys)
    centred = F.col(value) - F.avg(value).over(series)
    pairs = (
        df.withColumn("_x", centred)
        .withColumn("_y", F.lead("_x").over(series.orderBy(index)))
        .where(F.col("_y").isNotNull())
    )
    sums = pairs.groupBy(*keys).agg(
        F.sum(F.col("_x") * F.col("_x")).alias("_xx"), F.sum(F.col("_x") * F.col("_y")).alias("_xy"),
        F.sum(F.col("_y") * F.col("_y")).alias("_yy"), F.sum("_x").alias("_sx"), F.sum("_y").alias("_sy"),
        F.count(F.lit(1)).alias("_m"),
    )
    phi = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.coalesce(F.col("_xy") / F.nullif(F.col("_xx"), F.lit(0.0)), F.lit(0.0))))
    p, m = F.col("phi"), F.col("_m")
    mean = (F.col("_sy") - p * F.col("_sx")) / m
    square = (F.col("_yy") - F.lit(2.0) * p * F.col("_xy") + p * p * F.col("_xx")) / m
    return sums.withColumn("phi", phi).select(
        *keys, "phi", F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("sigma")
    )


def seasonal(
    df: DataFrame, keys: Sequence[str], index: str, day: str, value: str, n_draws: int, seed: int, unit: str = "D"
) -> DataFrame:
    """Seasonal median plus residuals drawn with replacement from the same series."""
    level = F.median(value).over(W.partitionBy(*keys, season_key(day, unit)))
    work = df.withColumn("_level", level).withColumn("_res", F.col(value) - F.col("_level"))
    pool = work.select(*keys, F.col(index).alias("_pick"), F.col("_res").alias("_drawn"))
    sized = work.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    pick = index_draw(F.col("_n"), seed, F.col("draw"), *[F.col(k) for k in keys], F.col(index)) - 1
    return (
        each_draw(sized, n_draws)
        .withColumn("_pick", pick)
        .join(pool, [*keys, "_pick"])
        .select(*keys, "draw", index, (F.col("_level") + F.col("_drawn")).alias("x"))
    )


def block(df: DataFrame, keys: Sequence[str], index: str, value: str, length: int, n_draws: int, seed: int) -> DataFrame:
    """Blocks with random starts, rescaled; a series under two blocks is resampled row by row."""
    work = each_draw(with_moments(df, keys, value), n_draws)
    names = [F.col(k) for k in keys]
    short = F.col("_n") < 2 * length
    number = F.floor(F.col(index) / F.lit(float(length)))
    start = index_draw(F.col("_n") - length + 1, seed, F.col("draw"), *names, number) - 1
    single = index_draw(F.col("_n"), seed, F.col("draw"), *names, F.col(index)) - 1
    pick = F.when(short, single).otherwise(start + F.col(index) - number * length)
    pool = df.select(*keys, F.col(index).alias("_pick"), F.col(value).alias("x"))
    drawn = work.withColumn("_pick", pick).join(pool, [*keys, "_pick"]).withColumn("_raw", F.col("x"))
    out = rescale(drawn, [*keys, "draw"], "x", F.col("_mean"), F.col("_std"))
    return out.select(*keys, "draw", index, F.when(short, F.col("_raw")).otherwise(F.col("x")).alias("x"))


def water_years(
    df: DataFrame, keys: Sequence[str], index: str, day: str, value: str, n_draws: int, seed: int, min_days: int = 100
) -> DataFrame:
    """Whole water years in random order; short years are left out and the tail is original."""
    rows = df.withColumn("_wy", water_year(day))
    years = rows.groupBy(*keys, "_wy").agg(F.count(F.lit(1)).alias("_len"), F.min(index).alias("_from"))
    usable = each_draw(years.where(F.col("_len") > min_days), n_draws)
    order = W.partitionBy(*keys, "draw").orderBy(
        uniform(seed, F.col("draw"), *[F.col(k) for k in keys], F.col("_wy")), "_wy"
    )
    placed = usable.withColumn("_to", F.coalesce(F.sum("_len").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    moved = (
        placed.select(*keys, "draw", "_from", "_to", F.explode(F.sequence(F.lit(0), F.col("_len") - 1)).alias("_k"))
        .select(*keys, "draw", (F.col("_from") + F.col("_k")).alias("_pick"), (F.col("_to") + F.col("_k")).alias(index))
        .join(df.select(*keys, F.col(index).alias("_pick"), F.col(value).alias("_moved")), [*keys, "_pick"])
        .select(*keys, "draw", index, "_moved")
    )
    return (
        each_draw(df.select(*keys, index, value), n_draws)
        .join(moved, [*keys, "draw", index], "left")
        .select(*keys, "draw", index, F.coalesce("_moved", value).alias("x"))
    )


def null_of(lead: str, start: int, x: np.ndarray, kind: str) -> np.ndarray:
    """A null series of the named family from a daily one, as the functions above draw it; ``lead`` holds seed, draw and keys."""
    n, at, lead = len(x), np.arange(len(x)), lead.encode()
    uniform = lambda places: hashed(lead, [b":%d" % p for p in places])
    if kind == "white":
        radius = np.sqrt(-2.0 * np.log(hashed(lead, [b":%d:a" % i for i in range(n)])))
        return x.mean() + x.std() * radius * np.cos(2.0 * np.pi * hashed(lead, [b":%d:b" % i for i in range(n)]))
    if kind == "block":
        if n < 180:
            return x[np.floor(uniform(range(n)) * n).astype(int)]
        begin = np.floor(uniform(range(-(-n // 90))) * (n - 89)).astype(int)
        y = x[begin[at // 90] + at % 90]
        return (y - y.mean()) / y.std() * x.std() + x.mean() if y.std() > 0 else np.full(n, x.mean())
    day = (start + at).astype("M8[D]")
    year = day.astype("M8[Y]")
    if kind == "seasonal":
        season = (day - year.astype("M8[D]")).astype(int)
        order = np.lexsort((x, season))
        size = np.bincount(season, minlength=366)
        low, ranked = np.cumsum(size) - size, x[order]
        level = (ranked[np.minimum(low + (size - 1) // 2, n - 1)] + ranked[np.minimum(low + size // 2, n - 1)])[season] / 2
        return level + (x - level)[np.floor(uniform(range(n)) * n).astype(int)]
    water = year.astype(int) + 1970 - (day.astype("M8[M]").astype(int) % 12 < 9)
    names, begin, size = np.unique(water, return_index=True, return_counts=True)
    used = size > 100
    names, begin, size = names[used], begin[used], size[used]
    y, to = x.copy(), 0
    for k in np.lexsort((names, uniform(names))):
        y[to : to + size[k]] = x[begin[k] : begin[k] + size[k]]
        to += size[k]
    return y


@F.pandas_udf(DOUBLES)
def null_values(prefix: pd.Series, first: pd.Series, series: pd.Series, family: pd.Series) -> pd.Series:
    """Vectorised helper: :func:`null_of` every packed daily series."""
    return pd.Series([null_of(*row) for row in zip(prefix, first, series, family)], dtype=object)


def packed_nulls(series: DataFrame, keys: Sequence[str], families: Sequence[str], n_draws: int, seed: int) -> DataFrame:
    """Null series of packed daily series (keys, first, xs): one row per series, family and draw, nothing shuffled."""
    every = each_draw(series.withColumn("family", F.explode(F.array(*[F.lit(f) for f in families]))), n_draws)
    prefix = F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), *[F.col(k).cast("string") for k in keys])
    values = once(null_values)(prefix, F.col("first"), F.col("xs"), F.col("family"))
    return every.select(*keys, "family", "draw", values.alias("xs"))


def null_slopes(days: DataFrame, keys: Sequence[str], families: Sequence[str], n_draws: int, seed: int) -> DataFrame:
    """Curves of the null series of anomalies of recorded days (keys, _rows): (keys, family, draw, tau, size, betas), a row per series that has one.

    The draws of a gauge and family are made and measured in one helper, one after the other: a null series is never handed on.
    """
    measure = curve_of()

    def work(first, x, family, names):
        x = anomaly_of(first, x)
        return [measure(null_of(f"{seed}:{draw}:{names}", first, x, family)) for draw in range(n_draws)]

    every = days.withColumn("family", F.explode(F.array(*[F.lit(f) for f in families])))
    names = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    found = every.select(*keys, "family", F.posexplode(per_series(work)("_rows.d", "_rows.v", "family", names)).alias("draw", "_found"))
    return found.where(F.col("_found").isNotNull()).select(*keys, "family", "draw", *curve_columns(F.col("_found")))


def null_series(
    df: DataFrame, keys: Sequence[str], index: str, day: str, value: str, family: str, n_draws: int, seed: int
) -> DataFrame:
    """Null series of a row family by name: (keys, draw, index, x). Draws are rows; the same seed gives the same series."""
    if family == "white":
        return white(df, keys, index, value, n_draws, seed)
    if family == "seasonal":
        return seasonal(df, keys, index, day, value, n_draws, seed)
    if family == "block":
        return block(df, keys, index, value, 90, n_draws, seed)
    if family == "water_year":
        return water_years(df, keys, index, day, value, n_draws, seed)
    raise ValueError(f"unknown family: {family}")
