"""Query registry and the shared steps of jobs and check SQL.

``step(name, text)`` stores one WITH clause; ``oracle(text)`` prepends every stored
step the text mentions, in dependency order, so a check reads like the job it checks.
Values are rounded in both engines because sums are formed in different orders.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tauscope.functions import ranks
from tauscope.operators import binning
from tauscope.plans import archive
from tauscope.session import materialise
from tauscope.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STEPS: dict[str, str] = {}
KEYS = adapters.GAUGE
MIN_UNITS = 5


def step(name: str, text: str) -> None:
    STEPS[name] = text.strip()


def oracle(text: str) -> str:
    ordered: list[str] = []

    def visit(body: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_][a-z_0-9]*\b", body)):
            if word in STEPS and word not in ordered:
                visit(STEPS[word])
                if word not in ordered:
                    ordered.append(word)

    visit(text)
    if not ordered:
        return text.strip()
    clauses = ",\n".join(f"{n} AS MATERIALIZED (\n{STEPS[n]}\n)" for n in ordered)
    return f"WITH {clauses}\n{text.strip()}"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every floating column (``special`` overrides digits by column).

    As the check engine does: the scaled value to the nearest integer, then scaled back, so that values half-way between two digits agree.
    """

    def near(name: str):
        scale = F.lit(10.0 ** special.get(name, digits))
        # adding 0 turns a rounded -0.0 into 0.0
        return (F.round(F.col(name) * scale) / scale + F.lit(0.0)).alias(name)

    return df.select(*[near(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0e0 AS {name or expr}"


def rs(*columns: str, digits: int = 6) -> str:
    return ", ".join(r(c, digits=digits) for c in columns)


def uniform_sql(*parts: str) -> str:
    text = ", ".join(f"cast({p} AS varchar)" for p in parts)
    return f"((cast('0x' || substr(md5(concat_ws(':', {text})), 1, 8) AS bigint) + 5e-1) / 4294967296e0)"


def normal_sql(*parts: str) -> str:
    a, b = uniform_sql(*parts, "'a'"), uniform_sql(*parts, "'b'")
    return f"(sqrt(-2e0 * ln({a})) * cos(2e0 * pi() * {b}))"


def bin_sql(x: str = "x", lo: str = "lo", width: str = "width", n: str = "n_bins") -> str:
    place = f"round(({x} - {lo}) / nullif({width}, 0e0), 9)"
    return f"CASE WHEN {place} >= 0 AND {place} <= {n} THEN cast(greatest(ceil({place}) - 1, 0) AS int) END"


# ---- shared job steps -------------------------------------------------------------


_SHARED: dict[tuple[str, str, str], DataFrame] = {}


def shared(name: str, cut: bool = False):
    """Keep a job step that many queries start from: spilled to disk, rebuilt if lost.

    ``cut`` writes it to the checkpoint folder instead, so later plans start from its rows.
    """

    def wrap(fn):
        def cached(spark: SparkSession, d: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, name, d)
            if key not in _SHARED:
                made = fn(spark, d)
                _SHARED[key] = materialise(made) if cut else made.persist(StorageLevel.MEMORY_AND_DISK)
            return _SHARED[key]

        cached.fresh = fn
        return cached

    return wrap


def forget() -> None:
    """Drop every shared step, so that a query can be timed from its source files."""
    for df in _SHARED.values():
        df.unpersist()
    _SHARED.clear()
    ranks.release()


def daily(spark, d):
    return adapters.daily_flow(spark, d)


def anomaly(spark, d):
    """Packed anomalies, one row per gauge."""
    return archive.flow_anomaly(adapters.packed_flow(spark, d))


@shared("slopes", cut=True)
def slopes(spark, d):
    """The curves, packed in one row per gauge."""
    return archive.flow_slopes(adapters.packed_days(spark, d), KEYS)


def gauge_means(spark, d):
    """Memory time and mean slope ``b`` of every gauge, taken inside its row."""
    known = F.array_compact("betas")
    total = F.aggregate(known, F.lit(0.0), lambda a, b: a + b)
    return slopes(spark, d).select(*KEYS, "tau", (total / F.size(known)).alias("b"))


def curve(spark, d):
    return archive.slope_points(slopes(spark, d), KEYS)


def points(spark, d):
    return binning.unpivot_axes(curve(spark, d), [*KEYS, "beta"], {"frequency": "frequency", "de": "de"})


def unit_bins(spark, d, groups=("axis",), n_bins=24):
    """Unit-bin medians on both axes with edges pooled over ``groups``."""
    return binning.unit_bin_median(points(spark, d), list(groups), "gauge_id", n_bins=n_bins)


@shared("unit_bins", cut=True)
def packed_unit_bins(spark, d):
    """The medians of :func:`unit_bins` alone, from packed slopes: at most 48 rows per gauge."""
    return binning.packed_bins(slopes(spark, d), [], {"frequency": F.lit(1.0), "de": F.col("tau")}, carry=["gauge_id"])


# ---- the same steps in SQL --------------------------------------------------------

step("gauge_archive", """
SELECT s_suppkey, r_name AS archive, n_nationkey AS cluster
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
step("recorded", """
SELECT archive, lpad(cast(l_suppkey AS varchar), 8, '0') AS gauge_id, cast(l_shipdate AS date) AS day,
       round(sum(l_extendedprice), 2) AS q
FROM lineitem JOIN gauge_archive ON l_suppkey = s_suppkey GROUP BY ALL""")
step("recorded_span", "SELECT archive, gauge_id, min(day) AS lo, max(day) AS hi FROM recorded GROUP BY ALL")
step("grid_days", """
SELECT archive, gauge_id, cast(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS date) AS day FROM recorded_span""")
step("daily", """
SELECT g.archive, g.gauge_id, g.day, coalesce(q, 0e0) AS q
FROM grid_days g LEFT JOIN recorded r ON g.gauge_id = r.gauge_id AND g.day = r.day""")
step("season_free", """
SELECT archive, gauge_id, day, q - avg(q) OVER (PARTITION BY gauge_id, dayofyear(day)) AS a FROM daily""")
step("centred", """
SELECT *, a - median(a) OVER (PARTITION BY gauge_id) AS c, min(day) OVER (PARTITION BY gauge_id) AS first_day
FROM season_free""")
step("anomaly", """
SELECT archive, gauge_id, day, date_diff('day', first_day, day) AS i,
       coalesce(c / nullif(median(abs(c)) OVER (PARTITION BY gauge_id), 0), a) AS x
FROM centred""")
step("series_lists", """
SELECT archive, gauge_id, count(*) AS n, list(x - m ORDER BY i) AS xs
FROM (SELECT *, avg(x) OVER (PARTITION BY gauge_id) AS m FROM anomaly) GROUP BY ALL""")
step("acf_rows", """
SELECT archive, gauge_id, lag, n,
       list_dot_product(xs[1 : n - lag], xs[lag + 1 : n]) / list_dot_product(xs, xs) AS acf
FROM (SELECT *, unnest(range(0, least(730, n - 1) + 1)) AS lag FROM series_lists) WHERE n >= 3""")
step("acf_cut", """
SELECT *, min(CASE WHEN lag >= 1 AND acf <= 0 THEN lag END) OVER (PARTITION BY gauge_id) AS cut FROM acf_rows""")
step("taus", """
SELECT archive, gauge_id, sum(acf) - 5e-1 * (1e0 + arg_max(acf, lag)) AS tau, max(cut) IS NULL AS censored
FROM acf_cut WHERE cut IS NULL OR lag < cut GROUP BY ALL""")
step("basis", """
SELECT k, list((5e-1 - 5e-1 * cos(2e0 * pi() * j / 256e0)) * cos(2e0 * pi() * k * j / 256e0) ORDER BY j) AS wc,
          list((5e-1 - 5e-1 * cos(2e0 * pi() * j / 256e0)) * sin(2e0 * pi() * k * j / 256e0) ORDER BY j) AS ws
FROM range(1, 129) a(k), range(0, 256) b(j) GROUP BY k""")
step("segments", """
SELECT archive, gauge_id, s, xs[s * 128 + 1 : s * 128 + 256] AS seg
FROM (SELECT *, unnest(range(0, (n - 256) // 128 + 1)) AS s FROM series_lists WHERE n >= 256)""")
step("segments_free", """
SELECT archive, gauge_id, s, list_transform(seg, lambda v: v - list_avg(seg)) AS seg FROM segments""")
step("psd_rows", """
SELECT archive, gauge_id, k, k / 256e0 AS frequency, count(*) AS n_segments,
       avg((list_dot_product(seg, wc) ** 2 + list_dot_product(seg, ws) ** 2) / 96e0
           * CASE WHEN k < 128 THEN 2e0 ELSE 1e0 END) AS psd
FROM segments_free, basis GROUP BY ALL""")
step("slope_rows", """
SELECT archive, gauge_id, k, frequency, -regr_slope(lp, lf) OVER near AS beta,
       regr_intercept(lp, lf) OVER near AS intercept, regr_r2(lp, lf) OVER near AS r2,
       count(*) OVER near AS n_points, min(lf) OVER near AS log10_f_min, max(lf) OVER near AS log10_f_max
FROM (SELECT *, log10(frequency) AS lf, log10(psd) AS lp FROM psd_rows WHERE psd > 0)
WINDOW near AS (PARTITION BY gauge_id ORDER BY lf RANGE BETWEEN 45e-2 PRECEDING AND 45e-2 FOLLOWING)
QUALIFY count(*) OVER near >= 8""")
step("curve", """
SELECT archive, gauge_id, k, tau, frequency, frequency * tau AS de, log10(frequency * tau) AS log10_de, beta
FROM slope_rows JOIN taus USING (archive, gauge_id) WHERE tau > 0""")
step("points", """
SELECT archive, gauge_id, beta, 'frequency' AS axis, log10(frequency) AS x FROM curve
UNION ALL SELECT archive, gauge_id, beta, 'de', log10(de) FROM curve""")
step("edges", """
SELECT axis, quantile_cont(x, 25e-3) AS lo, (quantile_cont(x, 975e-3) - quantile_cont(x, 25e-3)) / 24e0 AS width,
       24 AS n_bins FROM points GROUP BY axis""")
step("placed", f"""
SELECT * FROM (SELECT p.*, lo, width, {bin_sql()} AS bin_id FROM points p JOIN edges USING (axis)) WHERE bin_id IS NOT NULL""")
step("unit_bins", """
SELECT axis, archive, gauge_id, bin_id, median(beta) AS beta_median, count(*) AS n_points,
       any_value(lo + (bin_id + 5e-1) * width) AS bin_center_log10
FROM placed GROUP BY axis, archive, gauge_id, bin_id""")
step("bin_variance", f"""
SELECT axis, bin_id, count(*) AS n_units, var_samp(beta_median) AS beta_var
FROM unit_bins GROUP BY ALL HAVING count(*) >= {MIN_UNITS} AND var_samp(beta_median) IS NOT NULL""")
step("axis_dispersion", """
SELECT axis, sum(beta_var * n_units) / sum(n_units) AS weighted_variance, avg(beta_var) AS mean_variance,
       median(beta_var) AS median_variance, count(*) AS n_bins, cast(sum(n_units) AS bigint) AS n_unit_bin_values
FROM bin_variance GROUP BY axis""")


SERIES = ["season_free", "centred", "anomaly", "series_lists", "acf_rows", "acf_cut", "taus", "segments", "segments_free", "psd_rows", "slope_rows"]


def series_steps(prefix: str, first: str = "season_free") -> None:
    """The steps from daily rows to memory times and slopes once more, for the rows of step ``{prefix}_daily``.

    ``first`` starts the copy later in the chain.
    """
    for name in SERIES[SERIES.index(first):]:
        step(f"{prefix}_{name}", re.sub(rf"\b(daily|{'|'.join(SERIES)})\b", rf"{prefix}_\1", STEPS[name]))
