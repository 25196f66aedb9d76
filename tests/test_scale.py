"""Steps that must not grow faster than their input: what a plan shuffles, sorts and reads."""

import datetime as dt
import io
from contextlib import redirect_stdout

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tauscope.functions import ranks
from tauscope.operators import evaluation as ev
from tauscope.operators import nulls, prep, spatial, spectral, stats
from tauscope.plans import archive, ensemble
from tauscope.sources import adapters


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def flow(spark, n=900, gauges=3):
    first = dt.date(1999, 11, 3)
    rng = np.random.default_rng(4)
    rows = [("X", f"g{g}", first + dt.timedelta(days=int(i)), float(rng.integers(1, 9999)) / 100) for g in range(gauges) for i in range(0, n, g + 1)]
    return spark.createDataFrame(rows, "archive string, gauge_id string, day date, q double")


def test_grid_is_one_shuffle_of_the_given_rows(spark):
    rows = flow(spark, 40)
    grid = prep.regular_grid(rows, ["archive", "gauge_id"], "day")
    assert plan(grid).count("Exchange") <= 4  # its entry in the tree and in the details, initial plan and AQE
    assert "Join" not in plan(grid)
    got = grid.where("gauge_id = 'g2'").orderBy("day").collect()
    assert [(r.day - got[0].day).days for r in got] == list(range(40)) and [i for i, r in enumerate(got) if r.q is not None] == list(range(0, 40, 3))


def test_gap_fill_computes_no_frame_anew_for_every_row(spark):
    grid = prep.regular_grid(flow(spark, 40), ["archive", "gauge_id"], "day")
    for filled in (prep.gap_fill_linear(grid, ["archive", "gauge_id"], "day", "q", 1, True), prep.fill_then(grid, ["archive", "gauge_id"], "day", "q", 1, "edge")):
        assert "unboundedfollowing" not in plan(filled).lower()


def test_packed_curves_match_the_rows_without_a_join(spark):
    keys = ["archive", "gauge_id"]
    rows = prep.zero_filled(flow(spark), keys, "day", "q")
    want = archive.gauge_curves(archive.gauge_anomaly(rows, keys), keys, max_lag=200).orderBy("gauge_id", "k").toPandas()
    packed = archive.packed_curves(archive.flow_anomaly(prep.daily_series(flow(spark), keys, "day", "q")), keys, max_lag=200)
    got = packed.orderBy("gauge_id", "k").toPandas()
    assert len(got) > 100 and (got["k"] == want["k"]).all() and np.allclose(got[["tau", "de", "beta"]], want[["tau", "de", "beta"]])
    assert "Join" not in plan(packed)


def test_memory_time_of_packed_series(spark):
    x = np.cos(np.arange(500) / 9.0)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", i, 2.0) for i in range(5)], "g string, i long, q double")
    rows = {r.g: r for r in spectral.tau_integral(spectral.acf(df, ["g"], "i", "q", 50), ["g"]).collect()}
    packed = {r.g: r for r in spectral.packed_tau(spectral.pack(df, ["g"], "i", "q"), ["g"], 50).collect()}
    assert {g: r.censored for g, r in rows.items()} == {g: r.censored for g, r in packed.items()} == {"a": False, "b": True}
    assert all(np.isclose(rows[g].tau, packed[g].tau) for g in rows)


def test_rounding_of_halves_as_in_the_check_engine(spark):
    from catalog.base import rounded

    df = spark.createDataFrame([(34036.3090625,), (28337.4784375,), (-0.0000004,)], "x double")
    assert [r.x for r in rounded(df).collect()] == [34036.309062, 28337.478438, 0.0]


def test_packed_baselines_match_the_rows(spark):
    keys = ["archive", "gauge_id"]
    split = prep.train_eval_split(prep.zero_filled(flow(spark), keys, "day", "q"), keys, "day", "q", min_values=365)
    packed = ev.packed_predictions(prep.daily_series(flow(spark), keys, "day", "q"), keys, ev.BASELINES)
    got = ev.prediction_rows(packed, keys).toPandas()
    plain = {"climatology": ev.climatology(split, keys, "day", "q"), "monthly_mean": ev.climatology(split, keys, "day", "q", "mean", "M"), "persistence": ev.persistence(split, keys, "day", "q")}
    skill = {(r.gauge_id, r.model_type): r for r in ev.packed_skill(packed, keys).collect()}
    for name, rows in plain.items():
        both = rows.toPandas().merge(got[got["model_type"] == name], on=["gauge_id", "day"])
        assert len(both) == len(got) / 3 and (both["split_x"] == both["split_y"]).all() and np.allclose(both["q_pred_x"], both["q_pred_y"])
        for r in ev.skill(rows.where("split = 'eval'"), keys, "q", "q_pred").collect():
            own = skill[r.gauge_id, name]
            assert own.n_pairs == r.n_pairs and np.isclose(own.nse, r.nse) and np.isclose(own.kge, r.kge)
    assert plan(ev.packed_skill(packed, keys)).count("Join") == 0


def test_packed_forecasts(spark):
    rows = ev.packed_forecasts(prep.daily_series(flow(spark, 400, 1), ["gauge_id"], "day", "q"), ["gauge_id"], list(ev.FORECASTS)).collect()
    x = np.array([r.q for r in flow(spark, 400, 1).orderBy("day").collect()])
    for r in rows:
        lost = len(x) - len(r.q_pred)
        want = {"last_day": x[:-1], "week_ago": x[:-7], "week_mean": [x[max(0, i - 7) : i].mean() for i in range(1, 400)]}
        month = np.array([x[max(0, i - 30) : i].mean() for i in range(1, 400)])
        want |= {"month_mean": month, "half": (x[:-1] + month) / 2}
        assert np.allclose(r.q_pred, want[r.model_type], atol=6e-5) and np.allclose(r.xs, x[lost:]) and r.train == 281 - lost


@pytest.mark.parametrize("n", [150, 900])
def test_packed_nulls_match_the_rows(spark, n):
    keys = ["archive", "gauge_id"]
    series = prep.daily_series(flow(spark, n, 2), keys, "day", "q")
    rows = spectral.grid_index(prep.zero_filled(flow(spark, n, 2), keys, "day", "q"), keys, "day")
    packed = nulls.packed_nulls(series, keys, ["white", "seasonal", "block", "water_year"], 2, 5)
    got = packed.select(*keys, "family", "draw", F.posexplode("xs").alias("i", "v")).toPandas()
    for family in got["family"].unique():
        want = nulls.null_series(rows, keys, "i", "day", "q", family, 2, 5).toPandas()
        both = want.merge(got[got["family"] == family], on=["gauge_id", "draw", "i"])
        assert len(both) == len(want) and np.allclose(both["x"], both["v"])


def test_chemistry_pairs_are_ranked_without_a_join(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"gauge_id": ["a"] * 80 + ["b"] * 20, "constituent": "cl", "q_use": rng.integers(1, 20, 100).astype(float), "concentration": rng.integers(1, 9, 100).astype(float)})
    pdf["sample_date"] = [dt.date(2000, 1, 1) + dt.timedelta(days=40 * i) for i in range(100)]
    out = stats.cq_relation(spark.createDataFrame(pdf))
    own = pdf[pdf["gauge_id"] == "a"]
    rows = out.collect()
    assert len(rows) == 1 and np.isclose(rows[0].cq_spearman, own["q_use"].rank().corr(own["concentration"].rank())) and "Join" not in plan(out)


def test_no_helper_runs_twice_on_a_series(spark):
    packed = archive.packed_curves(archive.flow_anomaly(prep.daily_series(flow(spark, 400, 1), ["gauge_id"], "day", "q")), ["gauge_id"])
    tree = packed._jdf.queryExecution().optimizedPlan().toString()
    assert [sum(name in line for line in tree.splitlines() if "ArrowEvalPython" in line) for name in ("filled(", "plain_anomaly(", "shares(", "density(")] == [1, 1, 1, 1]


def test_bucket_edges_do_not_depend_on_the_order_of_rows(spark):
    """Two branches of a plan read the edges; a sketch merged in another order cuts elsewhere, and offsets no longer fit."""
    rng = np.random.default_rng(8)
    rows = [(g, float(v)) for g, n in (("a", 30000), ("b", 40), ("c", 1)) for v in rng.normal(0, 1, n)]
    counts = spark.createDataFrame(rows, "g string, v double").withColumn("_n", F.lit(1))
    edges = lambda df: {r.g: (r._total, r._edges) for r in ranks.bucket_edges(df, ["g"], "v", 8).collect()}
    first = edges(counts.repartition(7))
    assert first == edges(counts.orderBy(F.desc("v")).coalesce(2)) == edges(counts.orderBy("v").repartition(5))
    assert first["b"] == (40, []) and first["c"] == (1, []) and len(first["a"][1]) == 7
    cut = np.bincount(np.searchsorted(first["a"][1], [v for g, v in rows if g == "a"]), minlength=8)
    assert cut.min() > 30000 / 8 / 2 and cut.max() < 30000 / 8 * 2
    assert "percentile_approx" not in plan(ranks.cumulative_counts(counts, ["g"], "v"))
    v = np.array([v for g, v in rows if g == "a"])
    got = {r.g: r.q for r in ranks.quantiles(counts, ["g"], "v", {"q": 0.37}).collect()}
    assert got["a"] == pytest.approx(np.quantile(v, 0.37), abs=1e-12) and got["c"] == rows[-1][1]


def test_containment_looks_a_place_up_once(spark):
    rng = np.random.default_rng(3)
    squares = [(i, float(a), float(b), float(h)) for i, (a, b, h) in enumerate(zip(rng.integers(0, 30, 40), rng.integers(0, 30, 40), rng.integers(1, 9, 40)))]
    ring = [(i, *e) for i, a, b, h in squares for e in ((a, b, a + h, b), (a + h, b, a + h, b + h), (a + h, b + h, a, b + h), (a, b + h, a, b))]
    edges = spark.createDataFrame(ring, "c int, x1 double, y1 double, x2 double, y2 double")
    areas = spark.createDataFrame([(i, h * h) for i, _a, _b, h in squares], "c int, area double")
    points = [(i, float(i * 7 % 25), float(i * 11 % 25)) for i in range(500)] + [(500, 99.0, 99.0), (501, None, 1.0)]
    df = spark.createDataFrame(points, "p int, x double, y double")
    got = {r.p: (r.n_containing, r.c) for r in spatial.containment_by_place(df, "p", edges, "c", areas, 4.0).collect()}
    for i, x, y in points:
        around = [(h * h, k) for k, a, b, h in squares if x is not None and a <= x <= a + h and b <= y <= b + h]
        assert got[i] == (len(around), min(around)[1] if around else None)
    met = spatial.point_in_polygon(df, "p", edges, "c", 4.0)
    assert "REPARTITION_BY_NUM" in plan(met)


def test_slopes_leave_a_series_without_a_shuffle(spark):
    keys = ["archive", "gauge_id"]
    series = archive.flow_anomaly(prep.daily_series(flow(spark), keys, "day", "q")).repartition(4).cache()
    points = plan(archive.packed_curves(series, keys))
    assert "Window" not in points and points.count("Exchange") == plan(series).count("Exchange")


def test_days_are_packed_before_gauges_are_named(spark):
    tree = adapters.packed_flow(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert tree.index("Join") < tree.index("collect_list")  # the join stands above the packing, so it meets one row per supplier


def test_null_slopes_stay_with_their_gauge(spark):
    keys = ["archive", "gauge_id"]
    rng = np.random.default_rng(8)
    betas = [[None] * 4 + [None if g and k == 9 else float(rng.normal()) for k in range(29)] for g in range(3)]
    df = spark.createDataFrame([("X", f"g{g}", 2.0 + g, 64, b) for g, b in enumerate(betas)], "archive string, gauge_id string, tau double, size int, betas array<double>")
    # as before, by rows: the spectra of a gauge's own frequencies, their sliding frames, and a join on the observed slopes
    spectra = spectral.analytic_spectra(df, keys).withColumnRenamed("betas", "seen").withColumn("_n", F.lit(64))
    rows = spectral.local_slope(spectral.density_rows(spectra, [*keys, "family"], 1.0, 64), [*keys, "family"], 0.9).toPandas()
    rows["observed"] = [betas[int(r.gauge_id[1])][r.k] for r in rows.itertuples()]
    want = rows.groupby(["gauge_id", "family"]).apply(lambda x: pd.Series({"n": len(x), "median_null": x["beta"].median(), "p": (x["beta"] >= x["observed"]).mean()}), include_groups=False).reset_index()
    out = ensemble.null_gauge_p(spectral.analytic_slopes(df, keys), ["gauge_id", "family"])
    got = out.orderBy("gauge_id", "family").toPandas()
    assert len(got) == len(want) == 15 and np.allclose(got[["n", "median_null", "p"]], want[["n", "median_null", "p"]])
    assert "Exchange" not in plan(out)
    totals = ensemble.empirical_p(ensemble.slope_pairs(spectral.analytic_slopes(df, keys), ["family"]), ["family"]).orderBy("family").toPandas()
    assert np.allclose(totals["p_share"], rows.assign(ge=rows["beta"] >= rows["observed"]).groupby("family")["ge"].mean())
