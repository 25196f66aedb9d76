"""Bootstraps, permutations, cross-fits and null series."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import KEYS, MIN_UNITS, curve, daily, gauge_means, normal_sql, packed_unit_bins, query, r, rounded, rs, series_steps, shared, slopes, step, uniform_sql
from catalog.dispersion import chain, gauge_tau, reduction_sql, scores, tau_with_attributes
from catalog.spectra import family_slopes
from tauscope.functions.rng import normal
from tauscope.operators import nulls, prep, resampling, spectral
from tauscope.plans import ensemble
from tauscope.sources import adapters

SEED = 20260531
step("tau_attributes", "SELECT * FROM gauge_tau JOIN attributes USING (gauge_id)")
DRAWS = 20

step("boot_order", f"SELECT gauge_id, row_number() OVER (ORDER BY {uniform_sql(str(SEED), chr(39) + 'order' + chr(39), 'gauge_id')}, gauge_id) AS slot FROM (SELECT DISTINCT gauge_id FROM unit_bins)")
step("boot_weights", f"""
SELECT p.draw, o.gauge_id, p.weight FROM (SELECT draw, cast(floor({uniform_sql(str(SEED), 'draw', 'slot')} * n) AS bigint) + 1 AS pick, count(*) AS weight
FROM boot_order, range(0, {DRAWS}) t(draw), (SELECT count(*) AS n FROM boot_order) GROUP BY ALL) p JOIN boot_order o ON o.slot = p.pick""")
step("boot_bins", """
SELECT draw, axis, bin_id, sum(weight) AS w, sum(weight * beta_median) AS wb, sum(weight * beta_median * beta_median) AS wbb, count(*) AS units
FROM unit_bins JOIN boot_weights USING (gauge_id) GROUP BY ALL""")


def boot_sql(gate, variance):
    return f"""SELECT draw, {r('f', 'raw_variance')}, {r('d', 'de_variance')}, {r('1e0 - d / f', 'reduction')} FROM (SELECT draw, max(CASE axis WHEN 'frequency' THEN v END) AS f, max(CASE axis WHEN 'de' THEN v END) AS d
FROM (SELECT draw, axis, sum({variance} * w) / sum(w) AS v FROM boot_bins WHERE {gate} GROUP BY ALL) GROUP BY draw)"""


step("boot_draws", boot_sql(f"units >= {MIN_UNITS}", "((wbb - wb * wb / w) / w)").replace("round(", "(").replace(", 6) + 0e0", ")"))


def boot(spark, d, sample=False):
    return resampling.boot_gauge_reduction(packed_unit_bins(spark, d), [], "gauge_id", DRAWS, SEED, MIN_UNITS, sample)


@query("bootstrap_indices", "SELECT draw, gauge_id, weight FROM boot_weights")
def _(spark, d):
    return resampling.bootstrap_weights(packed_unit_bins(spark, d), [], "gauge_id", DRAWS, SEED).select("draw", "gauge_id", "weight")


@query("boot_gauge_reduction", boot_sql(f"units >= {MIN_UNITS}", "((wbb - wb * wb / w) / w)"))
def _(spark, d):
    return rounded(boot(spark, d))


@query("boot_freq_weighted", boot_sql("w >= 2", "((wbb - wb * wb / w) / greatest(w - 1, 1))"))
def _(spark, d):
    return rounded(boot(spark, d, True))


@query("draw_summary", f"SELECT count(*) AS n_draws, {r('stddev_samp(reduction)', 'sd')}, {r('avg(CASE WHEN reduction > 0 THEN 1e0 ELSE 0e0 END)', 'probability_positive')}, {r('quantile_cont(reduction, 25e-3)', 'ci_low')}, {r('median(reduction)', 'median')}, {r('quantile_cont(reduction, 975e-3)', 'ci_high')} FROM boot_draws")
def _(spark, d):
    return rounded(resampling.draw_summary(boot(spark, d), []))


step("cluster_order", f"SELECT cluster, row_number() OVER (ORDER BY {uniform_sql(str(SEED), chr(39) + 'order' + chr(39), 'cluster')}, cluster) AS slot FROM (SELECT DISTINCT cluster FROM gauge_archive)")
step("cluster_picks", f"""SELECT draw, a.slot AS rep, b.cluster FROM (SELECT draw, slot, cast(floor({uniform_sql(str(SEED), 'draw', 'slot')} * n) AS bigint) + 1 AS pick
FROM cluster_order, range(0, 5) t(draw), (SELECT count(*) AS n FROM cluster_order)) a JOIN cluster_order b ON b.slot = a.pick""")
step("cluster_curve", "SELECT draw, c.gauge_id || '__clusterrep' || rep AS gauge_id, frequency, de, beta FROM curve c JOIN gauge_archive g ON c.gauge_id = lpad(cast(s_suppkey AS varchar), 8, '0') JOIN cluster_picks p ON p.cluster = g.cluster")


def clusters(spark, d):
    return adapters.archives(spark, d).select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("gauge_id"), "cluster")


@query("boot_cluster", reduction_sql(chain("clus", "cluster_curve", "draw", n_bins=12), "draw"))
def _(spark, d):
    return rounded(resampling.boot_cluster(slopes(spark, d), clusters(spark, d), "gauge_id", "cluster", 5, SEED, MIN_UNITS, 12))


step("geo_order", """SELECT gauge_id, row_number() OVER (ORDER BY slope, gauge_id) AS a, row_number() OVER (ORDER BY aridity, gauge_id) AS b, count(*) OVER () AS n FROM attributes WHERE slope IS NOT NULL AND aridity IS NOT NULL""")
geo_bins = "least({k}, greatest(1, floor(n / 20e0)))"


@query("cluster_labels", f"SELECT t.gauge_id, coalesce(cast(cast(greatest(ceil(round((a - 1) * {geo_bins.format(k=3)} / (n - 1), 9)) - 1, 0) AS int) AS varchar) || '_' || cast(cast(greatest(ceil(round((b - 1) * {geo_bins.format(k=4)} / (n - 1), 9)) - 1, 0) AS int) AS varchar), 'missing_geo') AS cluster_id FROM attributes t LEFT JOIN geo_order g USING (gauge_id)")
def _(spark, d):
    return resampling.geo_grid_labels(adapters.attributes(spark, d), "gauge_id", "slope", "aridity")


step("sub_curve", f"SELECT draw, c.* FROM curve c JOIN (SELECT * FROM (SELECT draw, gauge_id, row_number() OVER (PARTITION BY draw ORDER BY {uniform_sql(str(SEED), 'draw', 'gauge_id')}, gauge_id) AS n FROM gauge_tau, range(0, 5) t(draw)) WHERE n <= 30) USING (gauge_id)")


@query("subsample_stability", reduction_sql(chain("subs", "sub_curve", "draw", n_bins=12), "draw"))
def _(spark, d):
    return rounded(resampling.subsample(curve(spark, d), "gauge_id", 30, 5, SEED, MIN_UNITS, 12))


step("tau_slots", f"SELECT gauge_id, tau, row_number() OVER (ORDER BY {uniform_sql(str(SEED), chr(39) + 'order' + chr(39), 'gauge_id')}, gauge_id) AS n FROM gauge_tau")
step("tau_shuffle", f"SELECT draw, p.gauge_id, s.tau AS new_tau FROM (SELECT draw, gauge_id, row_number() OVER (PARTITION BY draw ORDER BY {uniform_sql(str(SEED), 'draw', 'gauge_id')}, gauge_id) AS n FROM gauge_tau, range(0, 5) t(draw)) p JOIN tau_slots s USING (n)")
step("shuffle_curve", "SELECT draw, gauge_id, frequency, frequency * new_tau AS de, beta FROM curve JOIN tau_shuffle USING (gauge_id)")
chain("shuf", "shuffle_curve", "draw", n_bins=12)
chain("raw12", "curve", n_bins=12)


@query("random_tau_null", f"SELECT draw, {r('d.weighted_variance', 'de_variance')}, {r('f.weighted_variance', 'raw_variance')}, {r('1e0 - d.weighted_variance / f.weighted_variance', 'reduction')} FROM shuf_disp d JOIN raw12_disp f ON d.axis = 'de' AND f.axis = 'frequency'")
def _(spark, d):
    return rounded(resampling.random_tau_null(curve(spark, d), "gauge_id", 5, SEED, MIN_UNITS, 12))


@query("perm_variance_reduction")
def _(spark, d):
    return rounded(resampling.random_tau_null(curve(spark, d), "gauge_id", 10, SEED + 1, 3, 12, ["archive"]))


STAT_DRAWS = 5000
step("stat_slots", f"SELECT gauge_id, 1e0 - de_msr / raw_msr AS v, row_number() OVER (ORDER BY {uniform_sql(str(SEED), chr(39) + 'order' + chr(39), 'gauge_id')}, gauge_id) AS slot FROM gauge_scores")
step("stat_draws", f"""SELECT draw, avg(v) AS mean, median(v) AS med, avg(CASE WHEN v > 0 THEN 1e0 ELSE 0e0 END) AS positive FROM (SELECT draw, cast(floor({uniform_sql(str(SEED), 'draw', 'slot')} * n) AS bigint) + 1 AS pick
FROM stat_slots, range(0, {STAT_DRAWS}) t(draw), (SELECT count(*) AS n FROM stat_slots)) p JOIN stat_slots s ON s.slot = p.pick GROUP BY draw""")
ends_sql = ", ".join(r(f"quantile_cont({c}, {q})", f"{n}_{e}") for c, n in (("mean", "mean"), ("med", "median"), ("positive", "positive")) for e, q in (("low", "25e-3"), ("high", "975e-3")))


@query("boot_statistic", f"""SELECT * FROM (SELECT count(*) AS n, {r('avg(v)', 'mean')}, {r('avg(CASE WHEN v > 0 THEN 1e0 ELSE 0e0 END)', 'positive')}, {r('median(v)', 'median')} FROM stat_slots),
(SELECT {ends_sql} FROM stat_draws)""")
def _(spark, d):
    return rounded(resampling.boot_statistic(scores(spark, d), [], "gauge_id", "gauge_reduction", STAT_DRAWS, SEED))


RHO_DRAWS = 2000
step("rho_slots", f"SELECT archive, gauge_id, tau AS x, b AS y, row_number() OVER (PARTITION BY archive ORDER BY {uniform_sql(str(SEED), chr(39) + 'order' + chr(39), 'gauge_id')}, gauge_id) AS slot, count(*) OVER (PARTITION BY archive) AS n FROM (SELECT archive, gauge_id, any_value(tau) AS tau, avg(beta) AS b FROM curve GROUP BY ALL) QUALIFY n >= 8")
step("rho_picks", f"SELECT s.archive, draw, s.x, s.y FROM (SELECT archive, draw, cast(floor({uniform_sql(str(SEED), 'draw', 'slot')} * n) AS bigint) + 1 AS pick FROM rho_slots, range(0, {RHO_DRAWS}) t(draw)) p JOIN rho_slots s ON s.archive = p.archive AND s.slot = p.pick")
mean_rank = lambda x, by: f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2e0)"
step("rho_draws", f"SELECT archive, draw, corr(a, b) AS rho FROM (SELECT archive, draw, {mean_rank('x', 'archive, draw')} AS a, {mean_rank('y', 'archive, draw')} AS b FROM rho_picks) GROUP BY ALL")
step("rho_whole", f"SELECT archive, count(*) AS n, corr(a, b) AS rho FROM (SELECT archive, {mean_rank('x', 'archive')} AS a, {mean_rank('y', 'archive')} AS b FROM rho_slots) GROUP BY ALL")


@query("boot_rho", f"""SELECT archive, n, {r('w.rho', 'rho')}, rho_boot_median, rho_low, rho_high FROM rho_whole w JOIN (SELECT archive, {r('median(rho)', 'rho_boot_median')},
{r('quantile_cont(rho, 25e-3)', 'rho_low')}, {r('quantile_cont(rho, 975e-3)', 'rho_high')} FROM rho_draws WHERE isfinite(rho) GROUP BY archive) USING (archive)""")
def _(spark, d):
    return rounded(resampling.boot_rho(gauge_means(spark, d), ["archive"], "gauge_id", "tau", "b", RHO_DRAWS, SEED))


#: The eight control sets, on the attributes that the tables have.
CONTROL_SETS = {
    "unadjusted": [], "area": ["area"], "climate": ["aridity", "snow_fraction"], "topography": ["elevation", "slope", "area"],
    "hydroclimate": ["aridity", "snow_fraction", "area"], "geology": ["slope"], "combined_core": ["area", "aridity", "elevation", "slope"],
    "combined_extended": ["area", "aridity", "snow_fraction", "elevation", "slope"],
}
PERMUTATIONS = 2000


def control_steps(name, controls):
    """Partial rank correlations by orthogonal projection: controls made orthonormal one after the other, as lists in gauge order."""
    present = " AND ".join(f"{c} IS NOT NULL" for c in ("tau", "baseflow_index", *controls))
    centred = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0 - (count(*) OVER () + 1) / 2e0"
    ranks = ", ".join(f"{centred(c)} AS v{i}" for i, c in enumerate(controls, 1))
    step(f"pp_{name}", f"SELECT gauge_id, {centred('tau')} AS vx, {centred('baseflow_index')} AS vy{', ' + ranks if ranks else ''} FROM tau_attributes WHERE {present}")
    lists = "".join(f", list(v{i} ORDER BY gauge_id) AS c{i}" for i in range(1, len(controls) + 1))
    last = f"pp_{name}_0"
    step(last, f"SELECT count(*) AS n, list(vx ORDER BY gauge_id) AS x, list(vy ORDER BY gauge_id) AS y{lists} FROM pp_{name}")
    off = lambda v, k: f"list_transform(range(1, n + 1), lambda k: {v}[k]" + "".join(f" - d{i} * q{i}[k]" for i in range(1, k)) + ")"
    dots = lambda v, k: "".join(f", list_dot_product({v}, q{i}) AS d{i}" for i in range(1, k))
    for j in range(1, len(controls) + 1):
        gone = f" EXCLUDE ({', '.join(f'd{i}' for i in range(1, j))})" if j > 1 else ""
        step(f"pp_{name}_{j}", f"SELECT * EXCLUDE (u), list_transform(u, lambda v: v / sqrt(list_dot_product(u, u))) AS q{j} FROM (SELECT *{gone}, {off(f'c{j}', j)} AS u FROM (SELECT *{dots(f'c{j}', j)} FROM {last}))")
        last = f"pp_{name}_{j}"
    k = len(controls) + 1
    step(f"pp_{name}_r", f"SELECT *, {off('x', k)} AS rx FROM (SELECT *{dots('x', k)} FROM {last})")
    rest = "".join(f" - list_dot_product(q{i}, y) ** 2" for i in range(1, k))
    rho = lambda y: f"list_dot_product(rx, {y}) / sqrt(list_dot_product(rx, rx) * (list_dot_product({y}, {y}){rest.replace(', y)', f', {y})')}))"
    order, draw = uniform_sql(str(SEED), "'order'", "gauge_id"), uniform_sql(str(SEED), "draw", "gauge_id")
    step(f"pp_{name}_p", f"""SELECT draw, list(s.vy ORDER BY t.gauge_id) AS yp FROM (SELECT draw, gauge_id, row_number() OVER (PARTITION BY draw ORDER BY {draw}, gauge_id) AS n FROM pp_{name}, range(0, {PERMUTATIONS}) t(draw)) t
JOIN (SELECT vy, row_number() OVER (ORDER BY {order}, gauge_id) AS n FROM pp_{name}) s USING (n) GROUP BY draw""")
    return rho("y"), f"""SELECT '{name}' AS controls, n, o AS partial_rho, count(*) AS n_perm, (count(*) FILTER (abs(p) >= abs(o) - 1e-12) + 1) / (count(*) + 1e0) AS p_value
FROM (SELECT n, {rho('y')} AS o, {rho('yp')} AS p FROM pp_{name}_r, pp_{name}_p) GROUP BY ALL"""


control_sql = {name: control_steps(name, cs) for name, cs in CONTROL_SETS.items()}
step("control_perms", " UNION ALL ".join(text for _, text in control_sql.values()))
step("control_rhos", " UNION ALL ".join(f"SELECT '{name}' AS controls, n, {rho} AS partial_rho FROM pp_{name}_r" for name, (rho, _) in control_sql.items()))


@query("perm_partial", f"SELECT controls, n, {rs('partial_rho')}, n_perm, {rs('p_value')} FROM control_perms")
def _(spark, d):
    return rounded(resampling.perm_partial(tau_with_attributes(spark, d), "gauge_id", "tau", "baseflow_index", CONTROL_SETS, PERMUTATIONS, SEED))


@query("partial_control_ladder", f"SELECT controls, n, {rs('partial_rho')} FROM control_rhos")
def _(spark, d):
    return rounded(resampling.control_grams(tau_with_attributes(spark, d), "gauge_id", "tau", "baseflow_index", CONTROL_SETS)[1].select("controls", "n", "partial_rho"))


step("perm_rows", "SELECT gauge_id, ln(tau) AS x, b AS y FROM gauge_tau JOIN (SELECT gauge_id, avg(beta) AS b FROM curve GROUP BY 1) USING (gauge_id)")
step("perm_slots", f"SELECT gauge_id, x, row_number() OVER (ORDER BY {uniform_sql(str(SEED), chr(39) + 'order' + chr(39), 'gauge_id')}, gauge_id) AS n FROM perm_rows")
step("perm_draws", f"SELECT draw, corr(s.x, p.y) AS c FROM (SELECT draw, gauge_id, y, row_number() OVER (PARTITION BY draw ORDER BY {uniform_sql(str(SEED), 'draw', 'gauge_id')}, gauge_id) AS n FROM perm_rows, range(0, 200) t(draw)) p JOIN perm_slots s USING (n) GROUP BY draw")


@query("perm_r2", f"""SELECT {r('o', 'observed')}, {r('(count(*) FILTER (abs(c) >= abs(o)) + 1) / (count(*) + 1e0)', 'p_value')}, {r('avg(c * c)', 'null_r2')}, {r('stddev_samp(c * c)', 'null_r2_sd')}, count(*) AS n_draws,
{r('(o * o - avg(c * c)) / stddev_samp(c * c)', 'z')} FROM perm_draws, (SELECT corr(x, y) AS o FROM perm_rows) GROUP BY o""")
def _(spark, d):
    rows = gauge_means(spark, d).select("gauge_id", F.log("tau").alias("x"), F.col("b").alias("y"))
    return rounded(resampling.perm_correlation(rows, "gauge_id", "x", "y", 200, SEED))


step("part_rows", f"""SELECT b AS y, log10(greatest(tau, 1e-1)) AS t, -log10(greatest(tau, 1e-1)) + 1e-1 * {normal_sql(str(SEED), 'gauge_id')} AS f FROM gauge_tau
JOIN (SELECT gauge_id, avg(beta) AS b FROM curve GROUP BY 1) USING (gauge_id)""")
step("part_r2", "SELECT count(*) AS n, rt * rt AS t, rf * rf AS f, (rt * rt + rf * rf - 2 * rt * rf * c) / (1 - c * c) AS tf FROM (SELECT y, corr(y, t) OVER () AS rt, corr(y, f) OVER () AS rf, corr(t, f) OVER () AS c FROM part_rows) GROUP BY rt, rf, c")


@query("variance_partition", f"SELECT subset, n, {rs('r2', 'unique_share')} FROM (SELECT n, unnest(['t', 'f', 't+f']) AS subset, unnest([t, f, tf]) AS r2, unnest([tf - f, tf - t, t + f - tf]) AS unique_share FROM part_r2)")
def _(spark, d):
    """Mean slope of a gauge by memory time, by a noisy inverse of it, and by both."""
    near = curve(spark, d).groupBy("gauge_id").agg(F.first("tau").alias("tau"), F.avg("beta").alias("y"))
    t = F.log10(F.greatest("tau", F.lit(0.1)))
    rows = near.withColumn("t", t).withColumn("f", -F.col("t") + 0.1 * normal(SEED, F.col("gauge_id")))
    return rounded(resampling.variance_partition(rows, "y", ["t", "f"]))


RANDOM_TAUS = 100


def crossfit_sql(prefix, rows, count, min_years):
    """Check steps of a cross-fit over segments; ``rows`` gives archive, gauge_id, seg, day, q."""
    step(f"{prefix}_rows", rows)
    step(f"{prefix}_valid", f"SELECT gauge_id FROM (SELECT gauge_id, seg FROM {prefix}_rows GROUP BY ALL HAVING (date_diff('day', min(day), max(day)) + 1) / 36525e-2 >= {min_years}) GROUP BY ALL HAVING count(*) = {count}")
    step(f"{prefix}_daily", f"SELECT archive, gauge_id || '#' || seg AS gauge_id, day, q FROM {prefix}_rows SEMI JOIN {prefix}_valid USING (gauge_id)")
    series_steps(prefix)
    step(f"{prefix}_tau", f"SELECT gauge_id AS unit, split_part(gauge_id, '#', 1) AS gauge, split_part(gauge_id, '#', 2) AS fold, tau FROM {prefix}_taus WHERE tau > 0 QUALIFY count(*) OVER (PARTITION BY split_part(gauge_id, '#', 1)) = {count}")
    step(f"{prefix}_other", f"SELECT a.unit, a.fold, a.tau, median(b.tau) AS other FROM {prefix}_tau a JOIN {prefix}_tau b ON a.gauge = b.gauge AND a.unit <> b.unit GROUP BY ALL")
    step(f"{prefix}_fits", f"SELECT unnest(['all', fold]) AS analysis_group, fold, unit AS gauge_id, frequency, frequency * tau AS same_de, frequency * other AS other_de, beta FROM {prefix}_slope_rows s JOIN {prefix}_other o ON s.gauge_id = o.unit")
    step(f"{prefix}_own", f"SELECT *, same_de AS de FROM {prefix}_fits")
    step(f"{prefix}_cross", f"SELECT *, other_de AS de FROM {prefix}_fits")
    step(f"{prefix}_used", f"SELECT DISTINCT o.unit, o.fold, o.other FROM {prefix}_other o JOIN {prefix}_fits f ON o.unit = f.gauge_id")
    slot = lambda u, by: f"row_number() OVER (PARTITION BY {by} ORDER BY {u}, unit) AS n"
    step(f"{prefix}_deal", f"""SELECT t.draw, t.unit, s.other FROM (SELECT draw, unit, fold, {slot(uniform_sql(str(SEED), 'draw', 'unit'), 'fold, draw')} FROM {prefix}_used, range(0, {RANDOM_TAUS}) v(draw)) t
JOIN (SELECT other, fold, {slot(uniform_sql(str(SEED), chr(39) + 'order' + chr(39), 'unit'), 'fold')} FROM {prefix}_used) s USING (fold, n)""")
    step(f"{prefix}_random", f"SELECT analysis_group, draw, gauge_id, frequency, frequency * r.other AS de, beta FROM {prefix}_fits f JOIN {prefix}_deal r ON r.unit = f.gauge_id")
    chain(f"{prefix}_a", f"{prefix}_own", "analysis_group")
    chain(f"{prefix}_b", f"{prefix}_cross", "analysis_group")
    chain(f"{prefix}_c", f"{prefix}_random", "analysis_group, draw")
    kinds = [("a", "frequency", "raw_frequency"), ("a", "de", "same_segment_tau"), ("b", "de", "crossfit_tau")]
    values = lambda k, axis: f"(SELECT analysis_group, cast(sum(n_units) AS bigint) AS n_unit_bin_values FROM {prefix}_{k}_bins WHERE axis = '{axis}' AND n_units >= {MIN_UNITS} AND beta_var IS NOT NULL GROUP BY ALL)"
    step(f"{prefix}_methods", " UNION ALL ".join(f"SELECT analysis_group, '{name}' AS method, weighted_variance, n_bins, n_unit_bin_values FROM {prefix}_{k}_disp JOIN {values(k, axis)} USING (analysis_group) WHERE axis = '{axis}'" for k, axis, name in kinds))
    step(f"{prefix}_raw", f"SELECT analysis_group, weighted_variance AS raw, n_units FROM {prefix}_methods JOIN (SELECT analysis_group, count(DISTINCT gauge_id) AS n_units FROM {prefix}_fits GROUP BY ALL) USING (analysis_group) WHERE method = 'raw_frequency'")
    step(f"{prefix}_gain", f"SELECT analysis_group, draw, 1e0 - weighted_variance / raw AS gain FROM {prefix}_c_disp JOIN {prefix}_raw USING (analysis_group) WHERE axis = 'de'")
    return f"""SELECT analysis_group, method, {rs('weighted_variance')}, n_units, n_bins, n_unit_bin_values, {r('1e0 - weighted_variance / raw', 'reduction')}, NULL::DOUBLE AS random_p05, NULL::DOUBLE AS random_p95, NULL::DOUBLE AS empirical_p
FROM {prefix}_methods JOIN {prefix}_raw USING (analysis_group) UNION ALL
SELECT analysis_group, 'random_tau', NULL, any_value(n_units), NULL, NULL, {r('median(gain)', 'reduction')}, {r('quantile_cont(gain, 5e-2)', 'random_p05')}, {r('quantile_cont(gain, 95e-2)', 'random_p95')},
{r('(count(*) FILTER (gain >= 1e0 - weighted_variance / raw) + 1) / (count(*) + 1e0)', 'empirical_p')} FROM {prefix}_gain JOIN {prefix}_raw USING (analysis_group) JOIN {prefix}_methods USING (analysis_group) WHERE method = 'crossfit_tau' GROUP BY analysis_group"""


SPAN = "SELECT *, epoch(cast(day AS timestamp)) AS t, epoch(cast(min(day) OVER w AS timestamp)) AS lo, epoch(cast(max(day) OVER w AS timestamp)) AS hi FROM daily WINDOW w AS (PARTITION BY gauge_id)"


@query("crossfit_half", crossfit_sql("half", f"SELECT archive, gauge_id, CASE WHEN t * 2 <= lo + hi THEN 'first' ELSE 'second' END AS seg, day, q FROM ({SPAN})", 2, 3.0))
def _(spark, d):
    return rounded(ensemble.crossfit(prep.packed_halves(adapters.packed_flow(spark, d)), KEYS, 2, RANDOM_TAUS, SEED, MIN_UNITS, 3.0))


@query("crossfit_blocks", crossfit_sql("quarter", f"SELECT archive, gauge_id, cast(least(floor((t - lo) / ((hi - lo) / 4e0)), 3) AS int) AS seg, day, q FROM ({SPAN})", 4, 1.5))
def _(spark, d):
    return rounded(ensemble.crossfit(prep.packed_blocks(adapters.packed_flow(spark, d), 4), KEYS, 4, RANDOM_TAUS, SEED, MIN_UNITS, 1.5))


step("fold_rows", f"SELECT *, cast(floor({uniform_sql(str(SEED), 'gauge_id')} * 5e0) AS int) AS fold FROM unit_bins")
step("fold_ref", "SELECT axis, t AS fold, bin_id, median(beta_median) AS mid FROM fold_rows JOIN range(0, 5) v(t) ON fold <> t GROUP BY ALL HAVING count(*) >= 8")


@query("kfold_reference", f"SELECT axis, fold, {r('avg(abs(beta_median - mid))', 'mean_abs_distance')}, {r('sqrt(avg((beta_median - mid) ** 2))', 'rmse')}, count(*) AS n_values FROM fold_rows JOIN fold_ref USING (axis, fold, bin_id) GROUP BY axis, fold")
def _(spark, d):
    return rounded(resampling.kfold_distance(packed_unit_bins(spark, d), ["axis"], "gauge_id", 5, SEED, 8))


def indexed(spark, d):
    return spectral.grid_index(daily(spark, d), KEYS, "day")


step("daily_index", "SELECT archive, gauge_id, day, q, date_diff('day', min(day) OVER w, day) AS i, avg(q) OVER w AS m, stddev_pop(q) OVER w AS s, count(*) OVER w AS n FROM daily WINDOW w AS (PARTITION BY gauge_id)")


@query("null_white", f"SELECT archive, gauge_id, 0 AS draw, i, {r('m + s * ' + normal_sql(str(SEED), '0', 'archive', 'gauge_id', 'i'), 'x', 3)} FROM daily_index")
def _(spark, d):
    return rounded(nulls.white(indexed(spark, d), KEYS, "i", "q", 1, SEED), 3)


@query("null_ar1_fit", f"SELECT archive, gauge_id, {r('p', 'phi')}, {r('stddev_pop(y - p * x)', 'sigma', 3)} FROM (SELECT *, greatest(-99e-2, least(99e-2, sum(x * y) OVER w / sum(x * x) OVER w)) AS p FROM (SELECT archive, gauge_id, q - m AS x, lead(q - m) OVER (PARTITION BY gauge_id ORDER BY i) AS y FROM daily_index) WHERE y IS NOT NULL WINDOW w AS (PARTITION BY gauge_id)) GROUP BY archive, gauge_id, p")
def _(spark, d):
    return rounded(nulls.ar1_fit(indexed(spark, d), KEYS, "i", "q"), 6, sigma=3)


step("season_pool", "SELECT archive, gauge_id, i, n, median(q) OVER (PARTITION BY gauge_id, dayofyear(day)) AS level, q - median(q) OVER (PARTITION BY gauge_id, dayofyear(day)) AS res FROM daily_index")


@query("null_seasonal", f"SELECT a.archive, a.gauge_id, 0 AS draw, a.i, {r('a.level + b.res', 'x', 3)} FROM (SELECT *, cast(floor({uniform_sql(str(SEED), '0', 'archive', 'gauge_id', 'i')} * n) AS bigint) AS pick FROM season_pool) a JOIN season_pool b ON a.gauge_id = b.gauge_id AND b.i = a.pick")
def _(spark, d):
    return rounded(nulls.seasonal(indexed(spark, d), KEYS, "i", "day", "q", 1, SEED), 3)


step("block_drawn", f"SELECT a.archive, a.gauge_id, a.i, a.m, a.s, b.q AS x FROM (SELECT *, cast(floor({uniform_sql(str(SEED), '0', 'archive', 'gauge_id', 'i // 90')} * (n - 89)) AS bigint) + i % 90 AS pick FROM daily_index) a JOIN daily_index b ON a.gauge_id = b.gauge_id AND b.i = a.pick")


@query("null_block", f"SELECT archive, gauge_id, 0 AS draw, i, {r('(x - avg(x) OVER w) / stddev_pop(x) OVER w * s + m', 'x', 3)} FROM block_drawn WINDOW w AS (PARTITION BY gauge_id)")
def _(spark, d):
    return rounded(nulls.block(indexed(spark, d), KEYS, "i", "q", 90, 1, SEED), 3)


step("wy_rows", "SELECT *, year(day) - CASE WHEN month(day) < 10 THEN 1 ELSE 0 END AS wy FROM daily_index")
step("wy_years", f"SELECT archive, gauge_id, wy, count(*) AS len, min(i) AS f, {uniform_sql(str(SEED), '0', 'archive', 'gauge_id', 'wy')} AS u FROM wy_rows GROUP BY ALL HAVING count(*) > 100")
step("wy_moved", "SELECT y.gauge_id, y.t + r.i - y.f AS i, r.q AS x FROM (SELECT *, coalesce(sum(len) OVER (PARTITION BY gauge_id ORDER BY u, wy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM wy_years) y JOIN wy_rows r ON r.gauge_id = y.gauge_id AND r.wy = y.wy")


@query("null_water_year", f"SELECT d.archive, d.gauge_id, 0 AS draw, d.i, {r('coalesce(x, q)', 'x', 3)} FROM daily_index d LEFT JOIN wy_moved w ON w.gauge_id = d.gauge_id AND w.i = d.i")
def _(spark, d):
    return rounded(nulls.water_years(indexed(spark, d), KEYS, "i", "day", "q", 1, SEED), 3)


FAMILIES, NULL_DRAWS, MIN_DAYS = ["white", "seasonal", "block", "water_year"], 10, 365 * 5
u_sql = lambda *parts: uniform_sql(str(SEED), "draw", "archive", "gauge_id", *parts)
step("ens_base", f"SELECT archive, gauge_id, day, i, x AS q, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s, count(*) OVER w AS n FROM anomaly WINDOW w AS (PARTITION BY gauge_id) QUALIFY count(*) OVER w >= {MIN_DAYS}")
step("ens_drawn", f"SELECT * FROM ens_base, range(0, {NULL_DRAWS}) t(draw)")
step("ens_white", f"SELECT archive, gauge_id, draw, i, m + s * {normal_sql(str(SEED), 'draw', 'archive', 'gauge_id', 'i')} AS x FROM ens_drawn")
step("ens_levels", "SELECT archive, gauge_id, i, median(q) OVER (PARTITION BY gauge_id, dayofyear(day)) AS level, q - median(q) OVER (PARTITION BY gauge_id, dayofyear(day)) AS res FROM ens_base")
step("ens_seasonal", f"SELECT a.archive, a.gauge_id, a.draw, a.i, l.level + b.res AS x FROM (SELECT *, cast(floor({u_sql('i')} * n) AS bigint) AS pick FROM ens_drawn) a JOIN ens_levels b ON a.gauge_id = b.gauge_id AND b.i = a.pick JOIN ens_levels l ON l.gauge_id = a.gauge_id AND l.i = a.i")
step("ens_blocks", f"SELECT a.archive, a.gauge_id, a.draw, a.i, a.m, a.s, b.q AS x FROM (SELECT *, cast(floor({u_sql('i // 90')} * (n - 89)) AS bigint) + i % 90 AS pick FROM ens_drawn) a JOIN ens_base b ON a.gauge_id = b.gauge_id AND b.i = a.pick")
step("ens_block", "SELECT archive, gauge_id, draw, i, (x - avg(x) OVER w) / stddev_pop(x) OVER w * s + m AS x FROM ens_blocks WINDOW w AS (PARTITION BY gauge_id, draw)")
step("ens_wy_rows", "SELECT *, year(day) - CASE WHEN month(day) < 10 THEN 1 ELSE 0 END AS wy FROM ens_base")
step("ens_wy_years", f"SELECT *, {u_sql('wy')} AS u FROM (SELECT archive, gauge_id, wy, count(*) AS len, min(i) AS f FROM ens_wy_rows GROUP BY ALL HAVING count(*) > 100), range(0, {NULL_DRAWS}) t(draw)")
step("ens_wy_moved", "SELECT y.gauge_id, y.draw, y.t + r.i - y.f AS i, r.q AS x FROM (SELECT *, coalesce(sum(len) OVER (PARTITION BY gauge_id, draw ORDER BY u, wy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM ens_wy_years) y JOIN ens_wy_rows r ON r.gauge_id = y.gauge_id AND r.wy = y.wy")
step("ens_water_year", "SELECT d.archive, d.gauge_id, d.draw, d.i, coalesce(x, q) AS x FROM ens_drawn d LEFT JOIN ens_wy_moved w ON w.gauge_id = d.gauge_id AND w.i = d.i AND w.draw = d.draw")
step("ens_anomaly", " UNION ALL ".join(f"SELECT archive, gauge_id || '#{f}#' || draw AS gauge_id, i, x FROM ens_{f}" for f in FAMILIES))
series_steps("ens", "series_lists")
step("ens_null", "SELECT archive, split_part(gauge_id, '#', 1) AS gauge_id, split_part(gauge_id, '#', 2) AS family, cast(split_part(gauge_id, '#', 3) AS int) AS draw, tau, frequency, frequency * tau AS de, beta FROM ens_slope_rows JOIN ens_taus USING (archive, gauge_id) WHERE tau > 0")
step("ens_rows", "SELECT family, draw, gauge_id, frequency, de, beta FROM ens_null UNION ALL SELECT 'observed', 0, gauge_id, frequency, de, beta FROM curve")
ensemble_sql = reduction_sql(chain("ens_cut", "ens_rows", "family, draw"), "family, draw")
step("ens_reductions", ensemble_sql.replace("round(", "(").replace(", 6) + 0e0", ")"))
step("ens_excess", "SELECT n.*, o.reduction AS observed FROM ens_reductions n, (SELECT reduction FROM ens_reductions WHERE family = 'observed') o WHERE family <> 'observed' AND n.reduction IS NOT NULL")
step("ens_summary", """SELECT family, any_value(observed) AS observed_reduction, count(*) AS n_null_draws, count(*) FILTER (reduction >= observed) AS null_draws_ge_observed, 1e2 * avg(CASE WHEN reduction <= observed THEN 1e0 ELSE 0e0 END) AS observed_percentile,
quantile_cont(reduction, 5e-2) AS null_p05, median(reduction) AS null_median, quantile_cont(reduction, 95e-2) AS null_p95, any_value(observed) - median(reduction) AS observed_minus_null_median, (count(*) FILTER (reduction >= observed) + 1) / (count(*) + 1e0) AS empirical_p FROM ens_excess GROUP BY family""")
SUMMARY = ("observed_reduction", "observed_percentile", "null_p05", "null_median", "null_p95", "observed_minus_null_median", "empirical_p")


@shared("null_curves", cut=True)
def null_curves(spark, d):
    return ensemble.null_curves(adapters.packed_days(spark, d), KEYS, FAMILIES, NULL_DRAWS, SEED, MIN_DAYS)


@shared("null_draws", cut=True)
def null_draws(spark, d):
    """Written: one row per family and draw, read several times by the summaries."""
    return ensemble.null_ensemble(null_curves(spark, d), slopes(spark, d), MIN_UNITS)


@query("null_ensemble", ensemble_sql)
def _(spark, d):
    return rounded(null_draws(spark, d))


@query("null_status", f"""SELECT b.archive, b.gauge_id, f.family, cast(t.draw AS int) AS draw, b.n_days, CASE WHEN reason = 'included' THEN 'included' ELSE 'failed' END AS status, reason, {rs('tau')}, coalesce(n_curve_points, 0) AS n_curve_points FROM (
SELECT b.archive, b.gauge_id, f.family, t.draw, b.n_days, c.tau, c.n_curve_points, CASE WHEN n_days < {MIN_DAYS} THEN 'short_record' WHEN n_curve_points IS NULL THEN 'no_curve' ELSE 'included' END AS reason
FROM (SELECT archive, gauge_id, count(*) AS n_days FROM anomaly GROUP BY ALL) b, (SELECT unnest({FAMILIES}) AS family) f, range(0, {NULL_DRAWS}) t(draw)
LEFT JOIN (SELECT gauge_id, family, draw, any_value(tau) AS tau, count(*) AS n_curve_points FROM ens_null GROUP BY ALL) c ON c.gauge_id = b.gauge_id AND c.family = f.family AND c.draw = t.draw)""".replace("SELECT b.archive, b.gauge_id, f.family, cast(t.draw AS int) AS draw, b.n_days, CASE WHEN reason", "SELECT archive, gauge_id, family, cast(draw AS int) AS draw, n_days, CASE WHEN reason"))
def _(spark, d):
    return rounded(ensemble.null_status(adapters.packed_days(spark, d), null_curves(spark, d), KEYS, "q", FAMILIES, NULL_DRAWS, MIN_DAYS))


@query("null_summary", f"SELECT family, n_null_draws, null_draws_ge_observed, {rs(*SUMMARY)} FROM ens_summary")
def _(spark, d):
    return rounded(ensemble.null_summary(null_draws(spark, d)))


@query("null_calibrated", f"""SELECT family, n_null_draws, null_draws_ge_observed, {rs(*SUMMARY, 'gauge_median', 'gauge_positive_share')}, {r('observed_reduction / null_median', 'observed_to_null_ratio')}, CASE WHEN observed_minus_null_median > 0 AND gauge_median > 0 AND gauge_positive_share > 5e-1 THEN 'passes excess gate'
WHEN observed_reduction > 0 THEN 'coordinate effect positive; excess gate fails' ELSE 'coordinate effect not positive' END AS verdict FROM ens_summary, (SELECT median(1e0 - de_msr / raw_msr) AS gauge_median, avg(CASE WHEN 1e0 - de_msr / raw_msr > 0 THEN 1e0 ELSE 0e0 END) AS gauge_positive_share FROM gauge_scores)""")
def _(spark, d):
    return rounded(ensemble.null_calibrated(ensemble.null_summary(null_draws(spark, d)), scores(spark, d)))


step("gauge_null", """SELECT c.gauge_id, f.family, count(*) AS n, median(f.beta) AS median_null, avg(CASE WHEN f.beta >= c.beta THEN 1e0 ELSE 0e0 END) AS p
FROM family_slopes f JOIN curve c USING (gauge_id, k) GROUP BY ALL""")


def gauge_null(spark, d):
    return ensemble.null_gauge_p(family_slopes(spark, d), ["gauge_id", "family"])


@query("null_gauge_p", f"SELECT gauge_id, family, n, {rs('median_null', 'p')} FROM gauge_null")
def _(spark, d):
    return rounded(gauge_null(spark, d))


@query("null_rejections", f"SELECT family, count(*) AS n_gauges, count(*) FILTER (p = 0) AS n_zero, count(*) FILTER (p <= 1e0 / n) AS n_smallest, {r('avg(CASE WHEN p < 67e-3 THEN 1e0 ELSE 0e0 END)', 'share_low')} FROM gauge_null GROUP BY family")
def _(spark, d):
    return rounded(ensemble.null_rejections(gauge_null(spark, d), ["family"]))


@query("null_tau_match", f"SELECT family, count(*) AS n_series, {r('median(e)', 'median_error')}, {r('quantile_cont(e, 75e-2) - quantile_cont(e, 25e-2)', 'iqr_error')} FROM (SELECT family, log10(any_value(n.tau)) - log10(any_value(o.tau)) AS e FROM ens_null n JOIN gauge_tau o USING (gauge_id) GROUP BY family, draw, gauge_id) GROUP BY family")
def _(spark, d):
    return rounded(ensemble.null_tau_match(null_curves(spark, d), gauge_tau(spark, d), KEYS))


@query("empirical_p", f"""SELECT family, {r('avg(CASE WHEN f.beta >= c.beta THEN 1e0 ELSE 0e0 END)', 'p_share')}, {r('(count(*) FILTER (f.beta >= c.beta) + 1) / (count(*) + 1e0)', 'p_plus_one')},
{r('1e2 * avg(CASE WHEN f.beta <= c.beta THEN 1e0 ELSE 0e0 END)', 'percentile')} FROM family_slopes f JOIN curve c USING (gauge_id, k) GROUP BY family""")
def _(spark, d):
    return rounded(ensemble.empirical_p(ensemble.slope_pairs(family_slopes(spark, d), ["gauge_id", "family"]), ["family"]))
