"""Rank statistics, multiple testing, chemistry, spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, r, rounded, rs, slopes, step
from catalog.dispersion import gauge_tau, tau_with_attributes
from catalog.ingest import chemistry, tracer
from catalog.spectra import well_levels
from tauscope.functions.ranks import quantiles
from tauscope.operators import spatial, spectral, stats
from tauscope.session import materialise
from tauscope.sources import adapters

ATTRIBUTES = ["area", "aridity", "baseflow_index", "snow_fraction", "elevation", "slope"]
names_sql = ", ".join(f"'{a}'" for a in ATTRIBUTES)
step("attribute_long", f"SELECT tau, unnest([{names_sql}]) AS attribute, unnest([{', '.join(ATTRIBUTES)}]) AS v FROM tau_attributes")


def rank_sql(x, by=""):
    p = f"PARTITION BY {by} " if by else ""
    c = f"PARTITION BY {by}, {x}" if by else f"PARTITION BY {x}"
    return f"(rank() OVER ({p}ORDER BY {x}) + (count(*) OVER ({c}) - 1) / 2e0)"


step("attribute_rho", f"SELECT attribute, count(*) AS n, corr(a, b) AS rho FROM (SELECT attribute, {rank_sql('tau', 'attribute')} AS a, {rank_sql('v', 'attribute')} AS b FROM attribute_long WHERE v IS NOT NULL) GROUP BY attribute HAVING count(*) >= 10")


@query("spearman", f"SELECT attribute, n, {rs('rho')} FROM attribute_rho")
def _(spark, d):
    return rounded(stats.attribute_rhos(tau_with_attributes(spark, d), ATTRIBUTES, "tau"))


@query("associations_with_p")
def _(spark, d):
    return rounded(stats.attribute_spearman(tau_with_attributes(spark, d), ATTRIBUTES, "tau"))


step("part_pvalues", "SELECT p_partkey AS test, p_brand AS family, CASE WHEN p_size = 7 THEN NULL ELSE ((p_partkey * 7919) % 10007 + 1) / 10008e0 END AS p FROM part")
step("bh_rows", "SELECT *, row_number() OVER (PARTITION BY family ORDER BY p NULLS LAST, test) AS k, count(p) OVER (PARTITION BY family) AS m FROM part_pvalues")


def part_p(spark, d):
    value = ((F.col("p_partkey") * 7919) % 10007 + 1) / F.lit(10008.0)
    return adapters.table(spark, d, "part").select(
        F.col("p_partkey").alias("test"), F.col("p_brand").alias("family"), F.when(F.col("p_size") != 7, value).alias("p")
    )


@query("bh_fdr", f"SELECT test, family, {r('CASE WHEN p IS NOT NULL THEN least(1e0, min(p * m / k) OVER (PARTITION BY family ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) END', 'q_value')} FROM bh_rows")
def _(spark, d):
    return rounded(stats.bh_fdr(part_p(spark, d), ["family"], "p", "test").select("test", "family", "q_value"))


@query("bh_fdr_null_as_one", f"SELECT test, family, {r('least(1e0, min(p1 * m / k) OVER (PARTITION BY family ORDER BY k DESC ROWS UNBOUNDED PRECEDING))', 'q_value')} FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p1, test) AS k, count(*) OVER (PARTITION BY family) AS m FROM (SELECT *, coalesce(p, 1e0) AS p1 FROM part_pvalues))")
def _(spark, d):
    return rounded(stats.bh_fdr(part_p(spark, d), ["family"], "p", "test", True).select("test", "family", "q_value"))


step("partial_ranks", f"SELECT {rank_sql('tau')} AS x, {rank_sql('baseflow_index')} AS y, {rank_sql('area')} AS c FROM tau_attributes")


@query("partial_spearman_pearson", f"SELECT count(*) AS n, {r('(corr(x, y) - corr(x, c) * corr(y, c)) / sqrt((1 - corr(x, c) ** 2) * (1 - corr(y, c) ** 2))', 'partial_rho')} FROM partial_ranks")
def _(spark, d):
    return rounded(stats.partial_spearman(tau_with_attributes(spark, d), "tau", "baseflow_index", ["area"]))


@query("partial_spearman_rank")
def _(spark, d):
    return rounded(stats.partial_spearman(tau_with_attributes(spark, d), "tau", "baseflow_index", ["area", "aridity"], True))


LOGIT = ["aridity", "baseflow_index", "snow_fraction"]
step("logit_rows", f"SELECT predictor, n, (v - m) / s AS z, y FROM (SELECT predictor, v, CASE WHEN tau > 51e-2 THEN 1e0 ELSE 0e0 END AS y, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s, count(*) OVER w AS n FROM (SELECT tau, unnest({LOGIT}) AS predictor, unnest([{', '.join(LOGIT)}]) AS v FROM tau_attributes) WHERE v IS NOT NULL WINDOW w AS (PARTITION BY predictor))")
step("logit_0", "SELECT predictor, 0e0 AS b0, 0e0 AS b1, 0e0 AS se FROM logit_rows GROUP BY predictor")
for k in range(12):  # Newton's steps, one after the other
    step(f"logit_{k + 1}", f"""SELECT predictor, b0 + (h11 * g0 - h01 * g1) / det AS b0, b1 + (h00 * g1 - h01 * g0) / det AS b1, sqrt(h00 / det) AS se FROM (SELECT *, h00 * h11 - h01 * h01 AS det FROM (
SELECT predictor, any_value(b0) AS b0, any_value(b1) AS b1, sum(y - mu) AS g0, sum((y - mu) * z) AS g1, sum(mu * (1 - mu)) AS h00, sum(mu * (1 - mu) * z) AS h01, sum(mu * (1 - mu) * z * z) AS h11
FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * z))) AS mu FROM logit_rows JOIN logit_{k} USING (predictor)) GROUP BY predictor))""")


@query("logit_per_sd", f"""SELECT predictor, cast(n AS int) AS n, {r('b1', 'coefficient', 5)}, {r('se', 'std_error', 5)}, {r('exp(b1)', 'odds_ratio', 5)}, {r('exp(b1 - 1959963984540054e-15 * se)', 'or_low', 5)}, {r('exp(b1 + 1959963984540054e-15 * se)', 'or_high', 5)}
FROM logit_12 JOIN (SELECT DISTINCT predictor, n FROM logit_rows) USING (predictor)""")
def _(spark, d):
    t = tau_with_attributes(spark, d).withColumn("slow", F.when(F.col("tau") > 0.51, 1.0).otherwise(0.0))
    return rounded(stats.logit_per_sd(t, LOGIT, "slow").drop("p_value", "q_value"), 5)


step("wx_rows", "SELECT l_returnflag AS g, l_quantity - 255e-1 + l_linenumber / 10e0 AS delta FROM lineitem")
step("wx_ranks", f"SELECT g, delta, {rank_sql('a', 'g')} AS rk FROM (SELECT *, round(abs(delta), 12) AS a FROM wx_rows WHERE delta <> 0)")


@query("wilcoxon_signed", f"SELECT g, count(*) AS n, {r('sum(CASE WHEN delta > 0 THEN rk ELSE 0 END)', 'w_plus', 1)}, {r('sum(CASE WHEN delta < 0 THEN rk ELSE 0 END)', 'w_minus', 1)} FROM wx_ranks GROUP BY g")
def _(spark, d):
    rows = adapters.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_quantity") - 25.5 + F.col("l_linenumber") / F.lit(10.0)).alias("delta"))
    return rounded(stats.wilcoxon(rows, ["g"], "delta").select("g", "n", "w_plus", "w_minus"), 1)


step("binomial_rows", "SELECT s_nationkey, count(*) AS n, count(*) FILTER (s_acctbal > 5500) AS k FROM supplier GROUP BY ALL")


@query("binomial_less", f"""SELECT s_nationkey, n, k, {r('least(1e0, sum(exp(lgamma(n + 1e0) - lgamma(i + 1e0) - lgamma(n - i + 1e0) + n * ln(5e-1))))', 'p_less', 8)}
FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM binomial_rows) GROUP BY s_nationkey, n, k""")
def _(spark, d):
    rows = adapters.table(spark, d, "supplier")
    return rounded(stats.binomial_less(rows, ["s_nationkey"], F.col("s_acctbal") > 5500), 8)


step("kendall_rows", "SELECT l_suppkey AS unit, l_linenumber AS model, avg(l_quantity) AS score, avg(l_discount) AS distance FROM lineitem GROUP BY ALL")
step("kendall_pairs", "SELECT a.unit, -sign(a.score - b.score) AS s, sign(a.distance - b.distance) AS t FROM kendall_rows a JOIN kendall_rows b ON a.unit = b.unit AND a.model < b.model")


@query("kendall_rank", f"""SELECT unit, n_models, best_by_score, best_by_distance, {r('kt', 'kendall_tau')} FROM (SELECT unit, count(*) AS n_models, arg_max(model, score) AS best_by_score, arg_min(model, distance) AS best_by_distance FROM kendall_rows GROUP BY unit)
JOIN (SELECT unit, sum(s * t) / sqrt(sum(abs(s)) * sum(abs(t))) AS kt FROM kendall_pairs GROUP BY unit) USING (unit) WHERE n_models >= 3""")
def _(spark, d):
    rows = adapters.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), F.col("l_linenumber").alias("model")).agg(F.avg("l_quantity").alias("score"), F.avg("l_discount").alias("distance"))
    return rounded(stats.kendall_ranks(rows, "unit", "model", "score", "distance"))


step("archive_taus", "SELECT archive, count(*) AS n_gauges, median(tau) AS median_tau, quantile_cont(tau, 25e-2) AS tau_q25, quantile_cont(tau, 75e-2) AS tau_q75 FROM (SELECT DISTINCT archive, gauge_id, tau FROM curve) GROUP BY archive")


@query("archive_compare", f"SELECT archive, n_gauges, {rs('median_tau', 'tau_q25', 'tau_q75')} FROM archive_taus")
def _(spark, d):
    """Memory times of all archives side by side, one row each."""
    rows = slopes(spark, d).select("archive", "gauge_id", "tau")
    spread = quantiles(rows, ["archive"], "tau", {"median_tau": 0.5, "tau_q25": 0.25, "tau_q75": 0.75})
    return rounded(rows.groupBy("archive").agg(F.count(F.lit(1)).alias("n_gauges")).join(spread, "archive"))


step("cq_rows", "SELECT gauge_id, constituent, sample_date, q_use, concentration, ln(q_use) AS lq, ln(concentration) AS lc FROM chemistry WHERE q_use > 0 AND concentration > 0")
step("cq_ranks", f"SELECT *, {rank_sql('q_use', 'gauge_id, constituent')} AS rq, {rank_sql('concentration', 'gauge_id, constituent')} AS rc FROM cq_rows")
step("cq_pairs", """SELECT gauge_id, constituent, count(*) AS n_samples, date_diff('day', cast(min(sample_date) AS date), cast(max(sample_date) AS date)) / 36525e-2 AS span_years, stddev_samp(lq) AS sd_log_discharge,
stddev_samp(lc) AS sd_log_concentration, regr_slope(lc, lq) AS cq_slope, regr_r2(lc, lq) AS cq_r2, stddev_samp(lc) / stddev_samp(lq) AS chem_variability_ratio, corr(rq, rc) AS cq_spearman
FROM cq_ranks GROUP BY ALL HAVING count(*) >= 30 AND span_years >= 5""")
CQ = ("span_years", "sd_log_discharge", "sd_log_concentration", "cq_slope", "cq_r2", "chem_variability_ratio", "cq_spearman")


@query("cq_relation", f"SELECT gauge_id, constituent, n_samples, {rs(*CQ)} FROM cq_pairs")
def _(spark, d):
    return rounded(stats.cq_relation(chemistry(spark, d)))


SETS = {"conservative": ["ca", "cl"], "all_solutes": ["ca", "cl", "doc"]}


def cq_gauges(spark, d):
    return stats.cq_gauge(stats.cq_relation(chemistry(spark, d)), SETS, gauge_tau(spark, d), 2)


@query("cq_gauge", f"""SELECT gauge_id, aggregation, count(DISTINCT constituent) AS n_constituents, {r('median(n_samples)', 'median_samples')}, {r('max(span_years)', 'max_span_years')},
{r('median(chem_variability_ratio)', 'median_damping')}, {r('median(abs(cq_slope))', 'median_abs_slope')}, {r('median(cq_spearman)', 'median_spearman')}, {r('median(cq_r2)', 'median_r2')}, {r('any_value(tau)', 'tau')}
FROM cq_pairs JOIN (VALUES ('conservative', 'ca'), ('conservative', 'cl'), ('all_solutes', 'ca'), ('all_solutes', 'cl'), ('all_solutes', 'doc')) t(aggregation, c) ON c = constituent JOIN gauge_tau USING (gauge_id)
GROUP BY gauge_id, aggregation HAVING count(DISTINCT constituent) >= 2""")
def _(spark, d):
    return rounded(cq_gauges(spark, d))


@query("cq_associations")
def _(spark, d):
    rows = stats.spearman(cq_gauges(spark, d), ["aggregation"], "median_damping", "tau")
    return rounded(stats.bh_fdr(rows.withColumn("p_value", stats.correlation_p("rho", "n")), [], "p_value", "aggregation"))


step("tracer_stream", "SELECT cadence, site, count(*) AS n_stream, stddev_samp(cl) AS stream_sd, quantile_cont(cl, 75e-2) - quantile_cont(cl, 25e-2) AS stream_iqr FROM tracer WHERE type = 'Stream' GROUP BY ALL HAVING count(*) >= 10")
step("tracer_input", "SELECT cadence, count(*) AS n_input, stddev_samp(cl) AS input_sd, quantile_cont(cl, 75e-2) - quantile_cont(cl, 25e-2) AS input_iqr FROM tracer WHERE type = 'Input' GROUP BY ALL HAVING count(*) >= 10")


@query("tracer_damping", f"SELECT cadence, site, n_stream, n_input, {rs('stream_sd', 'stream_iqr', 'input_sd', 'input_iqr')}, {r('stream_sd / input_sd', 'sd_ratio')}, {r('stream_iqr / input_iqr', 'iqr_ratio')} FROM tracer_stream JOIN tracer_input USING (cadence)")
def _(spark, d):
    return rounded(stats.tracer_damping(tracer(spark, d), "cl"))


# ---- joins in space ---------------------------------------------------------------

step("customer_points", "SELECT c_custkey AS well, ((c_custkey * 37) % 1000) / 2e0 AS x, ((c_custkey * 91) % 1000) / 2e0 AS y FROM customer")
step("scattered_points", "SELECT c_custkey AS well, c_acctbal AS level, CASE WHEN c_custkey % 97 <> 0 THEN ((c_custkey * 37) % 3000) / 2e0 END AS x, ((c_custkey * 91) % 3000) / 2e0 AS y FROM customer")
step("supplier_points", "SELECT s_suppkey AS gauge, ((s_suppkey * 53) % 500) / 1e0 AS x, ((s_suppkey * 17) % 500) / 1e0 AS y FROM supplier")


def well_points(spark, d):
    c = F.col("c_custkey")
    return adapters.table(spark, d, "customer").select(c.alias("well"), ((c * 37) % 1000 / F.lit(2.0)).alias("x"), ((c * 91) % 1000 / F.lit(2.0)).alias("y"))


def gauge_points(spark, d):
    s = F.col("s_suppkey")
    return adapters.table(spark, d, "supplier").select(s.alias("gauge"), ((s * 53) % 500 / F.lit(1.0)).alias("x"), ((s * 17) % 500 / F.lit(1.0)).alias("y"))


def scattered(spark, d):
    """Wells over an area that reaches far beyond the gauges; some have no easting."""
    c = F.col("c_custkey")
    x = F.when(c % 97 != 0, (c * 37) % 3000 / F.lit(2.0))
    return adapters.table(spark, d, "customer").select(c.alias("well"), F.col("c_acctbal").alias("level"), x.alias("x"), ((c * 91) % 3000 / F.lit(2.0)).alias("y"))


step("nearest_rows", """SELECT w.well, w.level, s.gauge, s.dist FROM scattered_points w LEFT JOIN (SELECT * FROM (SELECT p.well, g.gauge, sqrt((p.x - g.x) ** 2 + (p.y - g.y) ** 2) AS dist,
row_number() OVER (PARTITION BY p.well ORDER BY sqrt((p.x - g.x) ** 2 + (p.y - g.y) ** 2), g.gauge) AS k FROM scattered_points p, supplier_points g WHERE p.x IS NOT NULL) WHERE k = 1) s USING (well)""")


def nearest(spark, d):
    return spatial.nearest_join(scattered(spark, d), "well", gauge_points(spark, d), "gauge", 15.0)


@query("nearest_join", f"SELECT well, gauge, {r('dist', 'distance')} FROM nearest_rows")
def _(spark, d):
    return rounded(nearest(spark, d))


THRESHOLDS = [15, 25, 40, 60, 80, 120]
step("nearest_taus", f"SELECT unnest({THRESHOLDS}) AS threshold, dist, level, tau FROM nearest_rows JOIN gauge_tau ON gauge_id = lpad(cast(gauge AS varchar), 8, '0') WHERE level > 0")
step("nearest_rho", f"SELECT threshold, count(*) AS n, corr(a, b) AS rho FROM (SELECT threshold, {rank_sql('level', 'threshold')} AS a, {rank_sql('tau', 'threshold')} AS b FROM nearest_taus WHERE dist <= threshold) GROUP BY threshold")


@query("nearest_thresholds", f"SELECT cast(t.threshold AS double) AS threshold, coalesce(n, 0) AS n_pairs, {r('CASE WHEN n >= 8 THEN rho END', 'rho')} FROM (SELECT unnest({THRESHOLDS}) AS threshold) t LEFT JOIN nearest_rho USING (threshold)")
def _(spark, d):
    taus = gauge_tau(spark, d).select(F.col("gauge_id").cast("long").alias("gauge"), "tau")
    joined = nearest(spark, d).join(scattered(spark, d).select("well", "level"), "well").join(taus, "gauge")
    return rounded(spatial.nearest_thresholds(joined, THRESHOLDS, "level", "tau").drop("p_value"))


def squares(spark, d):
    """A square catchment around every gauge, as four edges."""
    half = (F.col("gauge") % 40 + 5).cast("double")
    g = gauge_points(spark, d).select("gauge", (F.col("x") - half).alias("a"), (F.col("x") + half).alias("b"), (F.col("y") - half).alias("c"), (F.col("y") + half).alias("e"), (half * half * 4).alias("area"))
    edge = lambda x1, y1, x2, y2: F.struct(F.col(x1).alias("x1"), F.col(y1).alias("y1"), F.col(x2).alias("x2"), F.col(y2).alias("y2"))
    ring = F.array(edge("a", "c", "b", "c"), edge("b", "c", "b", "e"), edge("b", "e", "a", "e"), edge("a", "e", "a", "c"))
    return g.select("gauge", F.inline(ring)), g.select("gauge", "area")


step("squares", "SELECT gauge, x - (gauge % 40 + 5) AS a, x + (gauge % 40 + 5) AS b, y - (gauge % 40 + 5) AS c, y + (gauge % 40 + 5) AS e, (gauge % 40 + 5) * (gauge % 40 + 5) * 4e0 AS area FROM supplier_points")


@query("point_in_polygon", "SELECT well, gauge FROM customer_points JOIN squares ON x BETWEEN a AND b AND y BETWEEN c AND e")
def _(spark, d):
    edges, _areas = squares(spark, d)
    return spatial.point_in_polygon_by_place(well_points(spark, d), "well", edges, "gauge", 20.0)


@query("containment", "SELECT w.well, count(gauge) AS n_containing, arg_min(gauge, area * 1e6 + gauge) AS gauge FROM customer_points w LEFT JOIN squares ON x BETWEEN a AND b AND y BETWEEN c AND e GROUP BY w.well")
def _(spark, d):
    edges, areas = squares(spark, d)
    return spatial.containment_by_place(well_points(spark, d), "well", edges, "gauge", areas, 20.0)


@query("storage_associations")
def _(spark, d):
    tau = spectral.tau_positive_acf(well_levels(spark, d), ["gw_well_id"], "i", "level").select(F.substring("gw_well_id", 2, 9).cast("int").alias("w"), F.col("tau").alias("well_tau"))
    gauges = tau_with_attributes(spark, d).withColumn("w", F.col("gauge_id").cast("int") % 60)
    # written: the ranks read this one row per gauge several times, and their plans would each hold the steps of both memory times
    both = materialise(gauges.join(tau, "w").select("tau", "well_tau", "baseflow_index", "area"))
    return rounded(stats.attribute_spearman(both, ["well_tau", "baseflow_index", "area"], "tau"))
