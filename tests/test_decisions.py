"""The decision test, null status rows and the variance partition against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tauscope.functions.rng import index_draw, uniform
from tauscope.operators import evaluation as ev
from tauscope.operators import resampling
from tauscope.plans import ensemble


def gap(a, b):
    """Median gap of binned medians of two curves given as (x, beta)."""
    x = np.concatenate([a[0], b[0]])
    lo, hi = np.percentile(x, [10, 90])
    width, gaps = (hi - lo) / 18, []
    place = lambda v: np.where((np.round((v - lo) / width, 9) >= 0) & (np.round((v - lo) / width, 9) <= 18), np.maximum(np.ceil(np.round((v - lo) / width, 9)) - 1, 0), -1)
    pa, pb = place(a[0]), place(b[0])
    for k in range(18):
        if (pa == k).any() and (pb == k).any():
            gaps.append(abs(np.median(a[1][pa == k]) - np.median(b[1][pb == k])))
    return np.median(gaps) if gaps else None


@pytest.fixture(scope="module")
def curves():
    rng = np.random.default_rng(1)
    f = np.arange(1, 129) / 256
    obs = {f"g{i}": (float(rng.uniform(2, 40)), rng.normal(1, 0.3, 128)) for i in range(7)}
    sim = {(g, m): (float(rng.uniform(2, 40)), rng.normal(1.1, 0.3, 128)) for g in obs for m in ("a", "b", "c")}
    return f, obs, sim


def test_five_distances(spark, curves):
    f, obs, sim = curves
    seed = 9
    o = spark.createDataFrame([(g, float(x), t, float(b)) for g, (t, bs) in obs.items() for x, b in zip(f, bs)], "u string, frequency double, tau double, beta double")
    s = spark.createDataFrame([(g, m, float(x), t, float(b)) for (g, m), (t, bs) in sim.items() for x, b in zip(f, bs)] + [("nobody", "a", 0.1, 1.0, 1.0)], "u string, m string, frequency double, tau double, beta double")
    got = {(r.u, r.m, r.variant): r.distance for r in ev.decision_distances(o, s, "u", "m", seed).collect()}
    assert {k[0] for k in got} == set(obs)
    names = spark.createDataFrame(list(sim), "u string, m string")
    order = [r.u for r in names.select("u").distinct().withColumn("o", uniform(seed, "order", F.col("u"))).orderBy("o", "u").collect()]
    n = F.lit(len(obs))
    picks = {(r.u, r.m): (r.a, r.b) for r in names.select("u", "m", index_draw(n, seed, "obs", F.col("u")).alias("a"), index_draw(n, seed, "sim", F.col("u"), F.col("m")).alias("b")).collect()}
    middle = np.median([t for t, _ in obs.values()])
    for (g, m), (t, b) in sim.items():
        own, beta = obs[g]
        a, c = (obs[order[k - 1]][0] for k in picks[g, m])
        axes = {"beta_de": (own, t), "beta_raw": (1, 1), "de_const": (middle, middle), "de_shuff": (a, c)}
        for name, (x, y) in axes.items():
            assert got[g, m, name] == pytest.approx(gap((np.log10(f * x), beta), (np.log10(f * y), b)))
        inside = [v[(f * k >= 0.5) & (f * k <= 2)].mean() for k, v in ((own, beta), (t, b))]
        assert got[g, m, "scalar"] == pytest.approx(abs(inside[1] - inside[0]))
        assert got[g, m, "de_const"] == pytest.approx(got[g, m, "beta_raw"])


def test_decisions_and_their_summary(spark):
    rng = np.random.default_rng(2)
    models, variants = ["a", "b", "c", "d"], ["beta_de", "beta_raw", "scalar", "de_const", "de_shuff"]
    metrics = [(f"g{i}", m, None if (i, m) == (0, "a") else float(np.round(rng.normal(), 1)), float(rng.random())) for i in range(30) for m in models if not (i == 1 and m in "ab")]
    dist = [(g, m, v, float(np.round(rng.random(), 1))) for g, m, *_ in metrics for v in variants if not (v == "scalar" and m == "d")]
    sets = {"four": (models, 4), "three": (["a", "b", "c"], 3)}
    frame = ev.decision_variants(spark.createDataFrame(metrics, "u string, m string, nse double, abs_log10_tau_error double"),
                                 spark.createDataFrame(dist, "u string, m string, variant string, distance double"), "u", "m", sets)
    got = {(r.model_set, r.u, r.variant): r for r in frame.collect()}
    want = {}
    for name, (of, least) in sets.items():
        for g in {x[0] for x in metrics}:
            own = {m: (n, e) for u, m, n, e in metrics if u == g and m in of and n is not None}
            if len(own) < least:
                continue
            best = min(own, key=lambda m: (-own[m][0], m))
            for v in variants:
                far = {m: x for u, m, w, x in dist if u == g and w == v and m in own}
                if len(far) >= least:
                    pick = min(far, key=lambda m: (far[m], m))
                    want[name, g, v] = (best, pick, own[pick][1] - own[best][1])
    assert {k: (r.best_by_nse, r.best_by_distance, pytest.approx(r.delta_tau_error)) for k, r in got.items()} == want
    rows = {(r.model_set, r.variant, r.subset): r for r in ev.decision_summary(frame, "u", 40, 3).collect()}
    for name, v in itertools.product(sets, variants):
        delta = [x[2] for k, x in want.items() if k[0] == name and k[2] == v]
        apart = [x[2] for k, x in want.items() if k[0] == name and k[2] == v and x[0] != x[1]]
        for subset, own in (("all", delta), ("disagreement", apart)):
            r = rows.get((name, v, subset))
            assert (r is None) == (not own)
            if r:
                assert r.n_gauges == len(own)
                if len(own) >= 5:
                    assert r.median_delta == pytest.approx(np.median(own)) and r.mean_delta == pytest.approx(np.mean(own)) and r.share_lower == pytest.approx(np.mean(np.array(own) < 0))
                    assert r.ci_low <= r.median_delta <= r.ci_high
                else:
                    assert r.median_delta is None
    grid = {(r.model_set, r.threshold): r.met for r in ev.threshold_grid(frame, [0.0, 1.1]).collect()}
    assert grid == {(s, t): t == 0.0 for s in sets for t in (0.0, 1.1)}
    ranks = frame.where("model_set = 'three' and variant = 'beta_de'").select("u", F.col("best_by_nse").alias("best_by_score"), "best_by_distance")
    sane = ev.rank_sanity(frame, ranks, "u", "three").first()
    assert (sane.agree_best_nse, sane.agree_best_beta) == (1.0, 1.0) and sane.n == len({k[1] for k in want if k[0] == "three"})


def test_status_of_null_series(spark):
    anomaly = spark.sql("SELECT 'x' AS archive, if(id < 400, 'long', 'short') AS gauge_id, id AS i, 1.0D AS q FROM range(0, 500)")
    curves = spark.sql("SELECT 'x' AS archive, 'long' AS gauge_id, 'white' AS family, 1 AS draw, 3.0D AS tau, 0.1D AS frequency FROM range(0, 9)")
    rows = {(r.gauge_id, r.draw): r for r in ensemble.null_status(anomaly, curves, ["archive", "gauge_id"], "q", ["white"], 2, 200).collect()}
    assert {k: (r.status, r.reason, r.n_curve_points) for k, r in rows.items()} == {
        ("long", 0): ("failed", "no_curve", 0), ("long", 1): ("included", "included", 9), ("short", 0): ("failed", "short_record", 0), ("short", 1): ("failed", "short_record", 0)}


def test_variance_partition(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=(3, 60))
    b = a + 0.5 * b
    y = a + c + rng.normal(size=60)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, a, b, c)] + [(None, 1.0, 1.0, 1.0)], "y double, a double, b double, c double")
    got = {r.subset: r for r in resampling.variance_partition(df, "y", ["a", "b", "c"]).collect()}
    cols = {"a": a, "b": b, "c": c}

    def r2(names):
        z = np.column_stack([np.ones(60), *[cols[n] for n in names]])
        return 1 - ((y - z @ np.linalg.lstsq(z, y, rcond=None)[0]) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    assert len(got) == 7 and all(r.n == 60 and r.r2 == pytest.approx(r2(s.split("+"))) for s, r in got.items())
    assert got["a"].unique_share == pytest.approx(r2("abc") - r2("bc")) and sum(r.unique_share for r in got.values()) == pytest.approx(r2("abc"))
