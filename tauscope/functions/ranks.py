"""Exact ranks, row numbers and quantiles that never gather a group in one task.

A plain ``row_number() over (order by x)`` or ``percentile(x)`` sends the whole group to
one task. Here every group is first cut into ordered buckets; window functions run
inside a bucket and a small table of bucket sizes supplies the offsets. Bucket edges
come from a bounded sample and only steer the work: results are exact. The sample is drawn by
a hash of the value, so that every branch of a plan that needs the edges finds the same ones; a merged sketch depends
on the order in which its parts arrive. Equal values are merged into counted rows before the shuffle, so a hot value is one row.
There is one plan at every size and no job while it is built; the shuffle width bounds the number of buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tauscope.session import materialise

_KEPT: list[DataFrame] = []
#: Distinct values that a bucket may hold before its group is cut, and sampled values to a bucket.
BUCKET, SAMPLED = 2048, 64


def keep(df: DataFrame) -> DataFrame:
    """Reuse a reduced table inside one plan: kept in memory or on disk, rebuilt if lost.

    Without it every reference would repeat the whole upstream plan.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(df)
    return df


def release() -> None:
    """Free the tables kept by earlier plans of this application."""
    while _KEPT:
        _KEPT.pop().unpersist()


def shuffle_width(df: DataFrame) -> int:
    """Number of shuffle partitions of the session: as many buckets keep every task busy."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _key(by: Sequence[str]) -> list:
    return list(by) if by else [F.lit(0)]


def same(df: DataFrame, other: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``by``; with no keys ``other`` is a single row attached to every row."""
    return df.join(other, list(by), how) if by else df.crossJoin(other)


def _offsets(sizes: DataFrame, by: Sequence[str], size: str) -> DataFrame:
    before = W.partitionBy(*_key(by)).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(
        *by, "_bucket", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("_offset")
    )


def bucketed_row_number(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], bucket: Column, name: str
) -> DataFrame:
    """Number rows 1..n inside ``by``; ``bucket`` must not decrease along ``order``."""
    marked = df.withColumn("_bucket", bucket)
    sizes = marked.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    inside = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy(*order))
    return (
        marked.withColumn("_inside", inside)
        .join(_offsets(sizes, by, "_size"), [*by, "_bucket"])
        .withColumn(name, (F.col("_inside") + F.col("_offset")).cast("long"))
        .drop("_bucket", "_inside", "_offset")
    )


def hash_order(
    df: DataFrame, by: Sequence[str], u: Column, tie: Sequence[str], name: str, buckets: int | None = None
) -> DataFrame:
    """Random permutation 1..n inside ``by``, ordered by the uniform column ``u``."""
    with_u = df.withColumn("_u", u)
    bucket = F.floor(F.col("_u") * F.lit(float(buckets or shuffle_width(df))))
    return bucketed_row_number(with_u, by, ["_u", *tie], bucket, name).drop("_u")


def value_counts(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct values with ``_n`` copies; ``weight`` names the copies of rows that are counted already."""
    copies = F.sum(weight) if weight else F.count(F.lit(1))
    return keep(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(copies.alias("_n")))


def bucket_edges(counts: DataFrame, by: Sequence[str], value: str, buckets: int, least: int = BUCKET) -> DataFrame:
    """Per group of counted values ``_total`` rows and ``_edges``, at most ``buckets`` - 1 sorted values that cut it about evenly.

    A group of at most ``least`` values is one bucket. Of a larger one the values whose hash is small are sorted: the rows alone
    decide the edges, not their order, their partitions or the attempt.
    """
    sizes = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_values"), F.sum("_n").alias("_total"))
    share = F.lit(float(SAMPLED * buckets)) / F.col("_values")
    drawn = same(counts, sizes, by).where(
        (F.col("_values") > least) & (F.pmod(F.xxhash64(value), F.lit(1 << 30)) < share * F.lit(float(1 << 30)))
    )
    sample = drawn.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("_sample"))
    buckets = max(buckets, 2)
    at = lambda i: F.element_at("_sample", (F.floor(i * F.size("_sample") / F.lit(buckets)) + 1).cast("int"))
    edges = F.when(F.size("_sample") > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), at)))
    none = F.array().cast(f"array<{counts.schema[value].dataType.simpleString()}>")
    return same(sizes, sample, by, "left").select(*by, "_total", F.coalesce(edges, none).alias("_edges"))


def cumulative_counts(
    df: DataFrame, by: Sequence[str], value: str, buckets: int | None = None, weight: str | None = None
) -> DataFrame:
    """One row per distinct value: ``_n`` copies, ``_cum`` rows at or below, ``_total``."""
    counts = value_counts(df, by, value, weight)
    groups = bucket_edges(counts, by, value, buckets or shuffle_width(df), BUCKET if buckets is None else 1)
    placed = same(counts, groups, by).withColumn(
        "_bucket", F.size(F.filter("_edges", lambda e: e < F.col(value)))
    ).drop("_edges")
    sizes = placed.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_size"))
    upto = W.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return (
        placed.withColumn("_inside", F.sum("_n").over(upto))
        .join(_offsets(sizes, by, "_size"), [*by, "_bucket"])
        .select(*by, value, "_n", (F.col("_inside") + F.col("_offset")).alias("_cum"), "_total")
    )


def suffix_min(df: DataFrame, by: Sequence[str], order: str, value: str, bucket: Column, name: str) -> DataFrame:
    """Smallest ``value`` at or after each row along ``order`` inside ``by``; ``bucket`` must not decrease along ``order``.

    The window runs inside a bucket; the minima of later buckets come from a table of one row per bucket.
    """
    marked = df.withColumn("_bucket", bucket)
    after = W.partitionBy(*_key(by)).orderBy("_bucket").rowsBetween(1, W.unboundedFollowing)
    later = marked.groupBy(*by, "_bucket").agg(F.min(value).alias("_least")).select(*by, "_bucket", F.min("_least").over(after).alias("_later"))
    inside = F.min(value).over(W.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(0, W.unboundedFollowing))
    return marked.withColumn("_inside", inside).join(later, [*by, "_bucket"]).withColumn(name, F.least("_inside", "_later")).drop("_bucket", "_inside", "_later")


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], buckets: int | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per ``by``, one column per prob."""
    cum = cumulative_counts(df, by, value, buckets)
    picks = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("_total") - 1)
        low = F.floor(position)
        high = F.least(low + 1, F.col("_total") - 1)
        hit = lambda at: F.max(
            F.when((F.col("_cum") - F.col("_n") <= at) & (at < F.col("_cum")), F.col(value))
        )
        picks += [
            hit(low).alias(f"_lo_{name}"),
            hit(high).alias(f"_hi_{name}"),
            F.max(position - low).alias(f"_at_{name}"),
        ]
    rows = cum.groupBy(*by).agg(*picks)
    lerp = [
        (
            F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_at_{n}")
        ).alias(n)
        for n in probs
    ]
    return rows.select(*by, *lerp)


def near_ranks(df: DataFrame, by: Sequence[str], value: str, places: Column, extra: DataFrame | None = None, scale: float = 1024.0) -> DataFrame:
    """Distinct values around a few wanted places, without sorting or shuffling the others: (by, name, first, last, value, _n, _cum, _total).

    ``places`` is an array of structs (name, first, last) of 0-based places in terms of ``_total`` and the columns of ``extra`` (one row
    per group); a value is kept if one of its copies has a place from first to last. ``value`` is a logarithm or as bounded: it is counted
    in cells of 1/``scale`` first, map-side combined, and only the cells that hold a wanted place are read again and counted by value.
    The few cells are written, which runs a job. Any distribution gives exact results; one that lies in a single cell is counted as by :func:`cumulative_counts`.
    """
    cell = F.floor(F.col(value) * F.lit(scale))
    known = df.where(F.col(value).isNotNull()).select(*by, value, cell.alias("_cell"))
    sizes = cumulative_counts(known.select(*by, "_cell"), by, "_cell")
    sizes = sizes if extra is None else same(sizes, F.broadcast(extra), by)
    among = (F.col("_cum") > F.col("first")) & (F.col("_cum") - F.col("_n") <= F.col("last"))
    wanted = sizes.select(*by, "_cell", "_n", "_cum", "_total", F.inline(places)).where(among)
    wanted = materialise(wanted.select(*by, "_cell", "name", "first", "last", (F.col("_cum") - F.col("_n")).alias("_below"), "_total"))
    inner = known.join(F.broadcast(wanted.select(*by, "_cell").distinct()), [*by, "_cell"])
    exact = cumulative_counts(inner, [*by, "_cell"], value).drop("_total").join(F.broadcast(wanted), [*by, "_cell"])
    return exact.withColumn("_cum", F.col("_cum") + F.col("_below")).where(among).select(*by, "name", "first", "last", value, "_n", "_cum", "_total")


def quantile_places(probs: Mapping[str, float], total: Column, under: Column | int = 0, over: Column | int = 0) -> Column:
    """Places that the quantiles of ``total`` values need, for :func:`near_ranks`; ``under`` and ``over`` widen them."""
    place = lambda p: F.floor(F.lit(float(p)) * (total - 1))
    return F.array(*[
        F.struct(F.lit(n).alias("name"), (place(p) - under).alias("first"), (F.least(place(p) + 1, total - 1) + over).alias("last")) for n, p in probs.items()
    ])


def cell_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """:func:`quantiles` of a logarithm, for tables too large to shuffle: ``df`` is read twice and only its counts are moved."""
    return interpolated(near_ranks(df, by, value, quantile_places(probs, F.col("_total"))), by, value, probs)


def interpolated(rows: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Quantiles of groups of ``_total`` values from the rows around their places (by, name, value, _cum)."""
    picks, lerp = [], []
    for n, p in probs.items():
        position = F.lit(float(p)) * (F.col("_total") - 1)
        low = F.floor(position)
        at = lambda place: F.min(F.when((F.col("name") == n) & (F.col("_cum") > place), F.col(value)))  # noqa: B023, E731
        picks += [at(low).alias(f"_lo_{n}"), at(F.least(low + 1, F.col("_total") - 1)).alias(f"_hi_{n}"), F.max(position - low).alias(f"_at_{n}")]
        lerp.append((F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_at_{n}")).alias(n))
    return rows.groupBy(*by).agg(*picks).select(*by, *lerp)


def _mean_rank(centred: bool = False) -> Column:
    """Mean rank of the copies of a value; ``centred`` takes off the mean of all ranks of its group."""
    rank = F.col("_cum") - (F.col("_n") - 1) / F.lit(2.0)
    return rank - (F.col("_total") + 1) / F.lit(2.0) if centred else rank


def average_ranks(
    df: DataFrame, by: Sequence[str], value: str, name: str, buckets: int | None = None
) -> DataFrame:
    """Attach the average rank of ``value`` inside ``by`` (ties share their mean rank)."""
    cum = cumulative_counts(df, by, value, buckets)
    return df.join(cum.select(*by, value, _mean_rank().alias(name)), [*by, value])


def rank_columns(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], prefix: str = "_r_", weight: str | None = None, centred: bool = False
) -> DataFrame:
    """Average ranks of several columns, each taken from ``df`` itself so plans stay flat."""
    out = df
    for column in columns:
        cum = cumulative_counts(df, by, column, weight=weight)
        out = out.join(cum.select(*by, column, _mean_rank(centred).alias(f"{prefix}{column}")), [*by, column])
    return out
