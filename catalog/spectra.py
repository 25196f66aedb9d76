"""Memory times, spectra, slopes and the memory-normalised axis."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import KEYS, ORACLES, STEPS, anomaly, curve, daily, query, r, rounded, rs, slopes, step
from catalog.ingest import wells
from tauscope.functions.expressions import norm_gauge
from tauscope.functions.tables import long_form
from tauscope.operators import prep, spectral
from tauscope.operators.binning import by_process
from tauscope.plans import archive
from tauscope.sources import adapters


@query("acf", f"SELECT archive, gauge_id, lag, n, {rs('acf')} FROM acf_rows")
def _(spark, d):
    return rounded(spectral.packed_acf(anomaly(spark, d), KEYS, 730))


@query("tau_integral", f"SELECT archive, gauge_id, censored, {rs('tau')} FROM taus")
def _(spark, d):
    return rounded(spectral.packed_tau(anomaly(spark, d), KEYS, 730))


@query("welch_psd", f"SELECT archive, gauge_id, k, n_segments, {rs('frequency', 'psd')} FROM psd_rows WHERE psd > 0")
def _(spark, d):
    return rounded(spectral.packed_welch(anomaly(spark, d), KEYS))


@query("local_slope", f"""SELECT archive, gauge_id, k, frequency AS f_center, n_points,
    {rs('beta', 'intercept', 'r2', 'log10_f_min', 'log10_f_max')} FROM slope_rows""")
def _(spark, d):
    return rounded(spectral.local_slope(spectral.packed_welch(anomaly(spark, d), KEYS), KEYS, 0.9), f_center=12)


@query("de_coordinate", f"SELECT archive, gauge_id, k, {rs('tau', 'frequency', 'de', 'log10_de', 'beta')} FROM curve")
def _(spark, d):
    return rounded(curve(spark, d).drop("frequency_hz"))


def well_levels(spark, d):
    """Monthly well levels without their monthly median, numbered in time."""
    w = wells(spark, d).select("gw_well_id", "day", "level")
    free = prep.deseason(w, ["gw_well_id"], "day", "level", "median", "M")
    return spectral.series_index(free, ["gw_well_id"], "day", "level")


step("well_index", """
SELECT gw_well_id, row_number() OVER (PARTITION BY gw_well_id ORDER BY day) - 1 AS i, level FROM
(SELECT gw_well_id, day, level - median(level) OVER (PARTITION BY gw_well_id, month(day)) AS level FROM wells)""")
step("well_rho", """
SELECT a.gw_well_id, lag, count(*) AS pairs, CASE WHEN stddev_pop(a.level) * stddev_pop(b.level) > 0 THEN corr(a.level, b.level) END AS rho
FROM (SELECT *, unnest(range(1, 121)) AS lag FROM well_index) a JOIN well_index b ON a.gw_well_id = b.gw_well_id AND b.i = a.i + lag GROUP BY ALL""")
step("well_tau", """
SELECT w.gw_well_id, any_value(n) AS n, 1e0 + 2e0 * coalesce(sum(rho), 0e0) AS tau, coalesce(max(lag), 0) AS lags_used
FROM (SELECT gw_well_id, count(*) AS n FROM well_index GROUP BY 1 HAVING count(*) >= 60) w LEFT JOIN
(SELECT * FROM (SELECT *, min(CASE WHEN pairs < 30 OR rho IS NULL OR rho <= 0 THEN lag END) OVER (PARTITION BY gw_well_id) AS stop FROM well_rho)
 WHERE stop IS NULL OR lag < stop) u ON w.gw_well_id = u.gw_well_id GROUP BY w.gw_well_id""")


@query("tau_positive_acf", f"SELECT gw_well_id, n, {rs('tau')}, lags_used FROM well_tau")
def _(spark, d):
    return rounded(spectral.tau_positive_acf(well_levels(spark, d), ["gw_well_id"], "i", "level"))


step("storage", """
SELECT gauge_id, variable, day - first_day AS i, v FROM (SELECT g.gauge_id, g.day, min(g.day) OVER (PARTITION BY g.gauge_id) AS first_day,
  unnest(['price', 'tax']) AS variable, unnest([coalesce(p, 0e0), coalesce(t, 0e0)]) AS v
  FROM grid_days g LEFT JOIN (SELECT lpad(cast(l_suppkey AS varchar), 8, '0') AS gauge_id, cast(l_shipdate AS date) AS day, round(sum(l_quantity), 2) AS p, round(sum(l_tax), 4) AS t
  FROM lineitem GROUP BY ALL) r ON g.gauge_id = r.gauge_id AND g.day = r.day)""")
step("storage_lists", "SELECT gauge_id, variable, count(*) AS n, list(v - m ORDER BY i) AS xs FROM (SELECT *, avg(v) OVER (PARTITION BY gauge_id, variable) AS m FROM storage) GROUP BY ALL")
step("storage_acf", """
SELECT gauge_id, variable, lag, list_dot_product(xs[1 : n - lag], xs[lag + 1 : n]) / list_dot_product(xs, xs) AS acf
FROM (SELECT *, unnest(range(0, least(1825, n - 1) + 1)) AS lag FROM storage_lists)""")


@query("tau_censored", f"""SELECT gauge_id, variable, {r('sum(acf) - 5e-1 * (1e0 + arg_max(acf, lag))', 'tau')}, max(cut) IS NULL AS censored FROM
(SELECT *, min(CASE WHEN lag >= 1 AND acf <= 0 THEN lag END) OVER (PARTITION BY gauge_id, variable) AS cut FROM storage_acf) WHERE cut IS NULL OR lag < cut GROUP BY ALL""")
def _(spark, d):
    rows = adapters.table(spark, d, "lineitem").groupBy(
        norm_gauge(F.col("l_suppkey"), 8).alias("gauge_id"), F.to_date("l_shipdate").alias("day")
    ).agg(F.round(F.sum("l_quantity"), 2).alias("price"), F.round(F.sum("l_tax"), 4).alias("tax"))
    grid = prep.regular_grid(rows, ["gauge_id"], "day").fillna(0.0, ["price", "tax"])
    long = long_form(grid, ["gauge_id", "day"], ["price", "tax"], "variable", "v")
    keys = ["gauge_id", "variable"]
    acf = spectral.acf(spectral.grid_index(long, keys, "day"), keys, "i", "v", 1825)
    return rounded(spectral.tau_integral(acf, keys))


step("low_flow", """
SELECT *, ln(greatest(q, 1e-6)) AS lq, row_number() OVER w AS rn, count(*) OVER p AS n_all, quantile_cont(q, 3e-1) OVER p AS low
FROM recorded WINDOW w AS (PARTITION BY gauge_id ORDER BY day), p AS (PARTITION BY gauge_id)""")
step("falling", """
SELECT *, coalesce(lq < lag(lq) OVER (PARTITION BY gauge_id ORDER BY day), false) AND q < low AND rn < n_all AS inside FROM low_flow""")
step("recession_runs", """
SELECT archive, gauge_id, run, count(*) AS n, -regr_slope(lq, rn) AS k FROM (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER
(PARTITION BY gauge_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM falling) WHERE inside GROUP BY ALL""")


@query("tau_recession_segments", f"""SELECT archive, gauge_id, count(*) AS n_segments, {r('1e0 / avg(k)', 'tau', 1)} FROM recession_runs
WHERE n >= 2 AND k > 0 AND k < 1 GROUP BY ALL HAVING count(*) >= 3""")
def _(spark, d):
    return rounded(spectral.tau_recession_segments(adapters.recorded_flow(spark, d), KEYS, "day", "q", min_run=2))


@query("tau_recession_simple", f"""SELECT archive, gauge_id, count(*) AS n_days, {r('1e0 / -avg(dl)', 'tau')} FROM (SELECT *, ln(q) - lag(ln(q)) OVER (PARTITION BY gauge_id ORDER BY day) AS dl FROM low_flow WHERE q > 0)
WHERE dl < 0 AND q < low GROUP BY ALL HAVING count(*) >= 10""")
def _(spark, d):
    return rounded(spectral.tau_recession_simple(adapters.recorded_flow(spark, d), KEYS, "day", "q"))


step("user_rows", "SELECT user_id, epoch_us(ts) / 1e6 AS t, value AS y FROM events")
step("user_stats", "SELECT user_id, min(t) AS t0, max(t) AS t1, avg(y) AS m, count(*) AS n FROM user_rows GROUP BY 1 HAVING count(*) >= 4")
step("user_waves", """
SELECT user_id, k, f0 * pow(f1 / f0, k / 31e0) AS frequency, y - m AS y, cos(2e0 * pi() * f0 * pow(f1 / f0, k / 31e0) * (t - t0)) AS c,
       sin(2e0 * pi() * f0 * pow(f1 / f0, k / 31e0) * (t - t0)) AS s
FROM (SELECT *, 1e0 / (t1 - t0) AS f0, 5e-1 * (n - 1) / (t1 - t0) AS f1 FROM user_stats) JOIN user_rows USING (user_id), range(0, 32) g(k) WHERE f1 > f0""")
step("user_sums", """
SELECT *, 5e-1 * atan2(2e0 * cs, cc - ss) AS w FROM (SELECT user_id, k, any_value(frequency) AS frequency, sum(y * c) AS yc, sum(y * s) AS ys, sum(c * c) AS cc,
sum(s * s) AS ss, sum(c * s) AS cs, sum(y * y) AS yy FROM user_waves GROUP BY user_id, k)""")


@query("lomb_scargle", f"""SELECT user_id, k, {r('log10(frequency)', 'log_f')}, {r('''(pow(cos(w) * yc + sin(w) * ys, 2) / (cos(w) * cos(w) * cc + 2 * cos(w) * sin(w) * cs + sin(w) * sin(w) * ss)
+ pow(cos(w) * ys - sin(w) * yc, 2) / (cos(w) * cos(w) * ss - 2 * cos(w) * sin(w) * cs + sin(w) * sin(w) * cc)) / yy''', 'psd')} FROM user_sums""")
def _(spark, d):
    e = adapters.table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"), F.col("value").alias("y"))
    out = spectral.lomb_scargle(e, ["user_id"], "t", "y", 32)
    return rounded(out.select("user_id", "k", F.log10("frequency").alias("log_f"), "psd"))


step("full_waves", STEPS["user_waves"].replace("31e0", "511e0").replace("range(0, 32)", "range(0, 512)"))
step("full_sums", STEPS["user_sums"].replace("user_waves", "full_waves"))


@query("lomb_scargle_full", ORACLES["lomb_scargle"][ORACLES["lomb_scargle"].index("SELECT user_id, k, round(log10(frequency)"):].replace("user_sums", "full_sums"))
def _(spark, d):
    """The whole grid of 512 frequencies; ``lomb_scargle`` above is the short grid of the benchmark."""
    e = adapters.table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"), F.col("value").alias("y"))
    out = spectral.lomb_scargle(e, ["user_id"], "t", "y", 512)
    return rounded(out.select("user_id", "k", F.log10("frequency").alias("log_f"), "psd"))


step("window_rows", """
SELECT archive, gauge_id, count(*) AS n_beta_rows, avg(beta) AS mean_beta_all, median(beta) AS median_beta_all,
       count(*) FILTER (de BETWEEN 5e-1 AND 2e0) AS n_beta_de_window, avg(beta) FILTER (de BETWEEN 5e-1 AND 2e0) AS mean_beta_de_window,
       median(beta) FILTER (de BETWEEN 5e-1 AND 2e0) AS median_beta_de_window FROM curve GROUP BY archive, gauge_id""")
WINDOW = ("mean_beta_all", "median_beta_all", "mean_beta_de_window", "median_beta_de_window")


@query("beta_window", f"SELECT archive, gauge_id, n_beta_rows, n_beta_de_window, {rs(*WINDOW)} FROM window_rows")
def _(spark, d):
    return rounded(spectral.beta_window(curve(spark, d), KEYS))


@query("beta_by_process", f"SELECT archive AS process, count(beta) AS n, {r('median(beta)', 'median')}, {r('avg(beta)', 'mean')}, {r('stddev_samp(beta)', 'std')} FROM curve GROUP BY archive")
def _(spark, d):
    return rounded(by_process(curve(spark, d).withColumnRenamed("archive", "process")))


@query("curve_features", f"""SELECT archive, gauge_id, count(*) AS n_points,
{r('CASE WHEN count(*) FILTER (de > 2) >= 3 THEN regr_slope(beta, log10_de) FILTER (de > 2) END', 'high_de_slope')},
{r('CASE WHEN count(*) FILTER (de < 5e-1) >= 3 THEN regr_slope(beta, log10_de) FILTER (de < 5e-1) END', 'low_de_slope')},
{r('CASE WHEN count(*) FILTER (de BETWEEN 5e-1 AND 2e0) >= 3 THEN avg(beta) FILTER (de BETWEEN 5e-1 AND 2e0) END', 'mean_beta_mid')},
{r('CASE WHEN count(*) FILTER (de BETWEEN 5e-1 AND 2e0) >= 3 THEN max(beta) FILTER (de BETWEEN 5e-1 AND 2e0) - min(beta) FILTER (de BETWEEN 5e-1 AND 2e0) END', 'beta_range_mid')},
{r('arg_min(de, smooth)', 'de_at_min_beta')}, {r('arg_min(beta, smooth)', 'min_beta')}
FROM (SELECT *, (coalesce(lag(beta) OVER w, 0) + beta + coalesce(lead(beta) OVER w, 0)) / 3e0 AS smooth FROM curve WINDOW w AS (PARTITION BY gauge_id ORDER BY de)) GROUP BY ALL""")
def _(spark, d):
    return rounded(spectral.curve_features(curve(spark, d), KEYS))


step("ar1_terms", """
SELECT *, greatest(0e0, least(995e-3, (tau - 5e-1) / (tau + 5e-1))) AS phi, 2e0 * pi() * frequency AS w FROM curve""")
step("ar1_curve", "SELECT *, 2e0 * phi * w * sin(w) / (1e0 + phi * phi - 2e0 * phi * cos(w)) AS ar1 FROM ar1_terms")


@query("ar1_beta_analytic", f"SELECT archive, gauge_id, k, {rs('phi', 'ar1')} FROM ar1_curve")
def _(spark, d):
    return rounded(curve(spark, d).select(*KEYS, "k", spectral.ar1_phi(F.col("tau")).alias("phi"), spectral.ar1_beta(F.col("frequency"), F.col("tau")).alias("ar1")))


def ar1_psd_sql(tau):
    phi = f"greatest(-995e-3, least(995e-3, exp(-1e0 / greatest({tau}, 2e-1))))"
    return f"(1e0 / greatest(1e0 + {phi} * {phi} - 2e0 * {phi} * cos(2e0 * pi() * greatest(1e-8, least(499999e-6, frequency))), 1e-12))"


long_sql = "pow(greatest(2e0 * sin(pi() * greatest(1e-8, least(499999e-6, frequency))), 1e-8), -2e0 * {d})"
step("family_psd", f"""
SELECT archive, gauge_id, k, tau, frequency, 'analytic_ar1' AS family, {ar1_psd_sql('tau')} AS psd FROM curve
UNION ALL SELECT archive, gauge_id, k, tau, frequency, 'analytic_two_timescale_ar', share * {ar1_psd_sql('fast')} + (1e0 - share) * {ar1_psd_sql('slow')}
FROM (SELECT *, greatest(25e-2, least(9e-1, (tau - slow) / (fast - slow))) AS share FROM (SELECT *, greatest(1e0, tau / 6e0) AS fast,
least(73e1, greatest(tau * 6e0, greatest(1e0, tau / 6e0) + 1e0)) AS slow FROM curve))
""" + "".join(f"UNION ALL SELECT archive, gauge_id, k, tau, frequency, 'analytic_arfima_d{x}', {ar1_psd_sql('tau')} * {long_sql.format(d=x + 'e0')} FROM curve\n" for x in ("0.15", "0.28", "0.40")))
step("family_slopes", """
SELECT archive, gauge_id, k, tau, family, frequency, -regr_slope(lp, lf) OVER near AS beta FROM (SELECT *, log10(frequency) AS lf, log10(psd) AS lp FROM family_psd)
WINDOW near AS (PARTITION BY gauge_id, family ORDER BY lf RANGE BETWEEN 45e-2 PRECEDING AND 45e-2 FOLLOWING) QUALIFY count(*) OVER near >= 8""")


def family_slopes(spark, d):
    return spectral.analytic_slopes(slopes(spark, d), KEYS)


def family_curves(spark, d):
    return archive.slope_points(family_slopes(spark, d), [*KEYS, "family"])


@query("psd_analytic", f"SELECT archive, gauge_id, family, k, {rs('beta')} FROM family_slopes")
def _(spark, d):
    return rounded(family_curves(spark, d).select(*KEYS, "family", "k", "beta"))


step("hour_median", "SELECT mag_type, time, n - median(n) OVER (PARTITION BY mag_type, dayofyear(time)) AS v, epoch(time) AS t FROM hourly")
step("hour_flat", "SELECT *, v - (regr_slope(v, t) OVER w * t + regr_intercept(v, t) OVER w) AS x FROM hour_median WINDOW w AS (PARTITION BY mag_type)")
step("hour_scaled", """
SELECT mag_type, time, coalesce((x - med) / coalesce(nullif(14826e-4 * mad, 0), nullif(sp, 0)), 0) AS x FROM (SELECT *, median(abs(x - med)) OVER (PARTITION BY mag_type) AS mad,
stddev_pop(x) OVER (PARTITION BY mag_type) AS sp FROM (SELECT *, median(x) OVER (PARTITION BY mag_type) AS med FROM hour_flat))""")
step("hour_lists", "SELECT mag_type, count(*) AS n, list(x ORDER BY time) AS xs FROM hour_scaled GROUP BY 1")
step("hour_segments", """
SELECT mag_type, list_transform(seg, lambda v: v - list_avg(seg)) AS seg FROM (SELECT mag_type, xs[s * 128 + 1 : s * 128 + 256] AS seg
FROM (SELECT *, unnest(range(0, (n - 256) // 128 + 1)) AS s FROM hour_lists))""")
step("hour_psd", """
SELECT mag_type, k, k / 256e0 / 36e2 AS frequency, 36e2 * avg((list_dot_product(seg, wc) ** 2 + list_dot_product(seg, ws) ** 2) / 96e0 * CASE WHEN k < 128 THEN 2e0 ELSE 1e0 END) AS psd
FROM hour_segments, basis GROUP BY ALL""")
step("hour_slopes", """
SELECT mag_type, k, frequency, -regr_slope(lp, lf) OVER near AS beta, count(*) OVER near AS n_points FROM (SELECT *, log10(frequency) AS lf, log10(psd) AS lp FROM hour_psd)
WINDOW near AS (PARTITION BY mag_type ORDER BY lf RANGE BETWEEN 375e-3 PRECEDING AND 375e-3 FOLLOWING) QUALIFY count(*) OVER near >= 8""")


def hourly_analysis(spark, d, **kw):
    events = adapters.catalogue(spark, d).select("mag_type", "time", F.lit(1.0).alias("one"))
    return archive.analyze_series(events, ["mag_type"], "time", "one", 1.0, "H", "count", **kw)


@query("analyze_series", f"SELECT mag_type, k, n_points, {r('beta', digits=4)}, {r('frequency * 864e2', 'de')} FROM hour_slopes")
def _(spark, d):
    out = hourly_analysis(spark, d)["beta_de"]
    return rounded(out.select("mag_type", "k", "n_points", "beta", "de"), 6, beta=4)


TAUS = [0.25, 1.0, 4.0, 16.0]


@query("tau_sweep", f"""SELECT mag_type, tau_days, count(*) AS n_beta_rows, count(*) FILTER (frequency * tau_days * 864e2 BETWEEN 5e-1 AND 2e0) AS n_beta_de_window,
{r('avg(beta) FILTER (frequency * tau_days * 864e2 BETWEEN 5e-1 AND 2e0)', 'mean_beta_de_window', 4)} FROM hour_slopes, (VALUES (25e-2), (1e0), (4e0), (16e0)) t(tau_days) GROUP BY ALL""")
def _(spark, d):
    slopes = hourly_analysis(spark, d)["beta"]
    out = archive.tau_sweep(slopes, ["mag_type"], TAUS)
    return rounded(out.select("mag_type", "tau_days", "n_beta_rows", "n_beta_de_window", "mean_beta_de_window"), 4)


@query("archive_gauges", f"""SELECT t.archive, t.gauge_id, {r('tau')}, coalesce(n_beta_rows, 0) AS n_curve_rows, {r('mean_beta_de_window')},
CASE WHEN tau <= 0 THEN 'invalid_tau_acf' WHEN n_beta_rows IS NULL THEN 'empty_beta_curve' WHEN n_beta_rows < 20 THEN 'few_beta_rows' ELSE 'included' END AS reason
FROM taus t LEFT JOIN window_rows w USING (gauge_id)""")
def _(spark, d):
    tau = spectral.packed_tau(anomaly(spark, d), KEYS, 730)
    return rounded(archive.gauge_summary(tau, spectral.beta_window(curve(spark, d), KEYS), KEYS, 20))


@query("event_sensitivity")
def _(spark, d):
    return rounded(archive.event_sensitivity(adapters.catalogue(spark, d), ["mag_type"], [2.5, 3.0, 3.5], ["H", "D"], TAUS))
