"""Calendars, gaps, seasons, trends, scales and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import KEYS, daily, query, r, rounded, rs, step
from catalog.ingest import glacier_raw, river
from tauscope.functions.expressions import energy_joule
from tauscope.operators import prep
from tauscope.sources import adapters, series

step("hour_span", "SELECT mag_type, min(date_trunc('hour', time)) AS lo, max(date_trunc('hour', time)) AS hi FROM catalogue GROUP BY 1")
step("hours", "SELECT mag_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS time FROM hour_span")
step("hourly", """
SELECT h.mag_type, h.time, cast(count(c.time) AS double) AS n, avg(magnitude) AS mean, coalesce(sum(pow(1e1, 524e-2 + 144e-2 * magnitude)), 0e0) AS energy
FROM hours h LEFT JOIN catalogue c ON c.mag_type = h.mag_type AND date_trunc('hour', c.time) = h.time GROUP BY ALL""")


@query("resample_mean", f"SELECT mag_type, time, {r('mean', 'value')} FROM hourly")
def _(spark, d):
    return rounded(prep.resample(adapters.catalogue(spark, d), ["mag_type"], "time", F.col("magnitude"), "H"))


@query("event_rate", f"SELECT mag_type, time, {r('n', 'value')} FROM hourly")
def _(spark, d):
    return rounded(prep.event_rate(adapters.catalogue(spark, d), ["mag_type"], "time", "H"))


@query("energy_rate", f"SELECT mag_type, time, {r('CASE WHEN energy > 0 THEN log10(energy) END', 'log_energy')} FROM hourly")
def _(spark, d):
    out = prep.resample(adapters.catalogue(spark, d), ["mag_type"], "time", energy_joule(F.col("magnitude")), "H", "sum")
    return rounded(out.select("mag_type", "time", F.when(F.col("value") > 0, F.log10("value")).alias("log_energy")))


step("gappy", """
SELECT g.archive, g.gauge_id, g.day, q FROM grid_days g LEFT JOIN recorded r ON g.gauge_id = r.gauge_id AND g.day = r.day""")


@query("regular_grid", f"SELECT archive, gauge_id, day, {rs('q')} FROM gappy")
def _(spark, d):
    return rounded(prep.regular_grid(adapters.recorded_flow(spark, d), KEYS, "day"))


def season_sql(stat, unit, name):
    return f"SELECT archive, gauge_id, day, {r(f'q - {stat}(q) OVER w', 'q')}, {r(f'{stat}(q) OVER w', 'seasonal_cycle')} FROM daily WINDOW w AS (PARTITION BY gauge_id, {unit}(day))"


@query("deseason_median", season_sql("median", "month", "q"))
def _(spark, d):
    return rounded(prep.deseason(daily(spark, d), KEYS, "day", "q", "median", "M"))


@query("deseason_mean", season_sql("avg", "dayofyear", "q"))
def _(spark, d):
    return rounded(prep.deseason(daily(spark, d), KEYS, "day", "q", "mean"))


step("gap_marks", """
SELECT *, row_number() OVER w AS i FROM gappy WINDOW w AS (PARTITION BY gauge_id ORDER BY day)""")
step("gap_sides", """
SELECT *, last_value(CASE WHEN q IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, last_value(q IGNORE NULLS) OVER p AS pv,
       first_value(CASE WHEN q IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ni, first_value(q IGNORE NULLS) OVER f AS nv
FROM gap_marks WINDOW p AS (PARTITION BY gauge_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
f AS (PARTITION BY gauge_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")


@query("gap_fill_linear", f"""SELECT archive, gauge_id, day, {r("CASE WHEN q IS NOT NULL THEN q WHEN i - pi <= 2 THEN coalesce(pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0), pv) END", 'q')} FROM gap_sides""")
def _(spark, d):
    return rounded(prep.gap_fill_linear(prep.regular_grid(adapters.recorded_flow(spark, d), KEYS, "day"), KEYS, "day", "q", 2))


step("filled_both", """
SELECT archive, gauge_id, day, CASE WHEN q IS NOT NULL THEN q WHEN i - pi <= 3 OR ni - i <= 3
  THEN coalesce(pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0), pv, nv) END AS q FROM gap_sides""")


@query("gap_fill_both", f"SELECT archive, gauge_id, day, {rs('q')} FROM filled_both")
def _(spark, d):
    grid = prep.regular_grid(adapters.recorded_flow(spark, d), KEYS, "day")
    return rounded(prep.gap_fill_linear(grid, KEYS, "day", "q", 3, True))


@query("detrend_linear", f"""SELECT archive, gauge_id, day, {r('q - (regr_slope(q, t) OVER w * t + regr_intercept(q, t) OVER w)', 'q', 4)}
FROM (SELECT *, epoch(cast(day AS timestamp)) / 86400e0 AS t FROM daily) WINDOW w AS (PARTITION BY gauge_id)""")
def _(spark, d):
    return rounded(prep.detrend_linear(daily(spark, d), KEYS, "day", "q"), 4)


step("robust", """
SELECT *, median(abs(q - med)) OVER (PARTITION BY gauge_id) AS mad, stddev_pop(q) OVER (PARTITION BY gauge_id) AS sp
FROM (SELECT *, median(q) OVER (PARTITION BY gauge_id) AS med FROM daily)""")


@query("robust_z", f"SELECT archive, gauge_id, day, {r('coalesce((q - med) / coalesce(nullif(14826e-4 * mad, 0), nullif(sp, 0)), 0)', 'q')} FROM robust")
def _(spark, d):
    return rounded(prep.robust_z(daily(spark, d), KEYS, "q"))


@query("mad_plain", f"SELECT archive, gauge_id, day, {r('coalesce((q - med) / nullif(mad, 0), q)', 'q')} FROM (SELECT *, median(abs(q - med)) OVER (PARTITION BY gauge_id) AS mad FROM (SELECT *, median(q) OVER (PARTITION BY gauge_id) AS med FROM recorded))")
def _(spark, d):
    return rounded(prep.mad_plain(adapters.recorded_flow(spark, d), KEYS, "q"))


@query("velocity_anomaly", f"""SELECT glacier_id, point_id, time, {r('coalesce((v - med) / coalesce(nullif(14826e-4 * mad, 0), nullif(sd, 0)), 0)', 'velocity_myr')}
FROM (SELECT *, median(abs(v - med)) OVER w AS mad, stddev_samp(v) OVER w AS sd FROM
(SELECT glacier_id, point_id, time, velocity_myr AS v, median(velocity_myr) OVER (PARTITION BY glacier_id, point_id) AS med FROM glacier_rows)
WINDOW w AS (PARTITION BY glacier_id, point_id))""")
def _(spark, d):
    rows = series.parse_glacier(glacier_raw(spark, d)).select("glacier_id", "point_id", "time", "velocity_myr")
    return rounded(prep.velocity_anomaly(rows, ["glacier_id", "point_id"], "velocity_myr"))


step("us_season", "SELECT archive, gauge_id, day, q - avg(q) OVER (PARTITION BY gauge_id, dayofyear(day)) AS q FROM recorded")
step("us_marks", """
SELECT g.archive, g.gauge_id, g.day, q, row_number() OVER (PARTITION BY g.gauge_id ORDER BY g.day) AS i
FROM grid_days g LEFT JOIN us_season r ON g.gauge_id = r.gauge_id AND g.day = r.day""")
step("us_sides", """
SELECT *, last_value(CASE WHEN q IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, last_value(q IGNORE NULLS) OVER p AS pv,
       first_value(CASE WHEN q IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ni, first_value(q IGNORE NULLS) OVER f AS nv
FROM us_marks WINDOW p AS (PARTITION BY gauge_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
f AS (PARTITION BY gauge_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
step("us_filled", """
SELECT archive, gauge_id, day, CASE WHEN q IS NOT NULL THEN q WHEN i - pi <= 30 THEN coalesce(pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0), pv) END AS q FROM us_sides""")


def plain_sql(source):
    return f"""SELECT archive, gauge_id, day, {r('coalesce((q - med) / nullif(mad, 0), q)', 'q')} FROM (SELECT *, median(abs(q - med)) OVER (PARTITION BY gauge_id) AS mad
FROM (SELECT *, median(q) OVER (PARTITION BY gauge_id) AS med FROM {source} WHERE q IS NOT NULL))"""


@query("anomaly_us", plain_sql("us_filled"))
def _(spark, d):
    return rounded(prep.anomaly_season_first(adapters.recorded_flow(spark, d), KEYS, "day", "q"))


step("fill_first", "SELECT archive, gauge_id, day, q - avg(q) OVER (PARTITION BY gauge_id, dayofyear(day)) AS q FROM filled_both WHERE q IS NOT NULL")


@query("anomaly_fill_first", plain_sql("fill_first"))
def _(spark, d):
    return rounded(prep.anomaly_fill_first(adapters.recorded_flow(spark, d), KEYS, "day", "q", 3))


@query("standardize_series", f"SELECT cast(day AS timestamp) AS time, {r('q', 'value')}, 'river' AS process, 'supplier' AS region, 'discharge' AS variable FROM recorded")
def _(spark, d):
    tidy = prep.standardize(river(spark, d), "time", "discharge_m3s", process="river", region="supplier", variable="discharge")
    return rounded(tidy)


@query("coverage_station", f"""SELECT gauge_id AS station_id, any_value('River ' || archive) AS river_name, min(day) AS start, max(day) AS "end",
count(DISTINCT day) AS n_days, {r("date_diff('day', min(day), max(day)) / 36525e-2", 'years')},
{r("1e0 - count(DISTINCT day) / (date_diff('day', min(day), max(day)) + 1)", 'missing_fraction')} FROM recorded GROUP BY gauge_id""")
def _(spark, d):
    rows = river(spark, d).withColumn("time", F.to_date("time"))
    return rounded(prep.coverage_station(rows, "station_id", "time", ["river_name"]))


@query("coverage_glacier", f"""SELECT glacier_id, point_id, count(*) AS n_records, min(day) AS start, max(day) AS "end", {r("date_diff('day', min(day), max(day)) / 36525e-2", 'years')},
{r('median(velocity_myr)', 'median_velocity')}, {r('median(velocity_error_myr)', 'median_error')}
FROM (SELECT *, cast(time AS date) AS day FROM glacier_rows) GROUP BY glacier_id, point_id""")
def _(spark, d):
    rows = series.parse_glacier(glacier_raw(spark, d)).withColumn("day", F.to_date("time"))
    return rounded(prep.coverage_glacier(rows, ["glacier_id", "point_id"], "day", "velocity_myr", "velocity_error_myr"))


step("segment_rows", """
SELECT archive, gauge_id, (date_diff('day', min(day), max(day)) + 1) / 36525e-2 AS n_years,
       greatest(0e0, 1e0 - count(q) / (date_diff('day', min(day), max(day)) + 1)) AS missing_fraction,
       1e0 - count(q) / count(*) AS null_fraction, sum(CASE WHEN q = 0 THEN 1 ELSE 0 END) / count(q) AS zero_fraction
FROM gappy GROUP BY archive, gauge_id""")


@query("coverage_segment", f"SELECT archive, gauge_id, {rs('n_years', 'missing_fraction', 'null_fraction', 'zero_fraction')} FROM segment_rows")
def _(spark, d):
    return rounded(prep.coverage_segment(prep.regular_grid(adapters.recorded_flow(spark, d), KEYS, "day"), KEYS, "day", "q"))


@query("coverage_filter", f"""SELECT archive, gauge_id, {rs('n_years', 'missing_fraction')}, CASE WHEN n_years < 681e-2 OR missing_fraction > 787e-3 THEN 'coverage_filter' ELSE 'included' END AS reason FROM segment_rows""")
def _(spark, d):
    cover = prep.coverage_segment(prep.regular_grid(adapters.recorded_flow(spark, d), KEYS, "day"), KEYS, "day", "q")
    return rounded(prep.coverage_reason(cover, 6.81, 0.787).select(*KEYS, "n_years", "missing_fraction", "reason"))


@query("trim_valid", f"""SELECT archive, gauge_id, day, {r('CASE WHEN q > 60000 THEN q END', 'q')} FROM (SELECT *, min(CASE WHEN q > 60000 THEN day END) OVER w AS lo,
max(CASE WHEN q > 60000 THEN day END) OVER w AS hi FROM recorded WINDOW w AS (PARTITION BY gauge_id)) WHERE day BETWEEN lo AND hi""")
def _(spark, d):
    flow = adapters.recorded_flow(spark, d).withColumn("q", F.when(F.col("q") > 60000, F.col("q")))
    return rounded(prep.trim_valid(flow, KEYS, "day", "q"))


@query("split_half", f"""SELECT archive, gauge_id, segment, count(*) AS n, {r('avg(q)', 'mean_q', 4)} FROM (SELECT *, CASE WHEN epoch(cast(day AS timestamp)) * 2 <=
epoch(cast(min(day) OVER w AS timestamp)) + epoch(cast(max(day) OVER w AS timestamp)) THEN 'first' ELSE 'second' END AS segment FROM recorded WINDOW w AS (PARTITION BY gauge_id)) GROUP BY ALL""")
def _(spark, d):
    halves = prep.split_half(adapters.recorded_flow(spark, d), KEYS, "day")
    return rounded(halves.groupBy(*KEYS, "segment").agg(F.count(F.lit(1)).alias("n"), F.avg("q").alias("mean_q")), 4)


step("block_rows", """
SELECT archive, gauge_id, day, q, cast(least(floor((day - lo) / ((hi - lo) / 4e0)), 3) AS int) AS block
FROM (SELECT *, min(day) OVER w AS lo, max(day) OVER w AS hi FROM recorded WINDOW w AS (PARTITION BY gauge_id))""")


@query("split_blocks", f"SELECT archive, gauge_id, block, count(*) AS n, {r('avg(q)', 'mean_q', 5)} FROM block_rows GROUP BY ALL")
def _(spark, d):
    blocks = prep.split_blocks(adapters.recorded_flow(spark, d), KEYS, "day", 4)
    return rounded(blocks.groupBy(*KEYS, "block").agg(F.count(F.lit(1)).alias("n"), F.avg("q").alias("mean_q")), 5)


step("split_rows", """
SELECT archive, gauge_id, day, q, CASE WHEN row_number() OVER (PARTITION BY gauge_id ORDER BY day) <= floor(7e-1 * count(*) OVER (PARTITION BY gauge_id)) + 1
THEN 'train' ELSE 'eval' END AS split FROM daily""")


@query("train_eval_split", f"SELECT archive, gauge_id, day, split, {rs('q')} FROM split_rows")
def _(spark, d):
    return rounded(prep.train_eval_split(daily(spark, d), KEYS, "day", "q", min_values=365))


@query("water_year", """SELECT archive, gauge_id, year(day) - CASE WHEN month(day) < 10 THEN 1 ELSE 0 END AS water_year, count(*) AS n_days
FROM daily GROUP BY ALL HAVING count(*) > 100""")
def _(spark, d):
    return prep.water_year_days(daily(spark, d), KEYS, "day")
