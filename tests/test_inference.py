"""Nearest sites, multiple testing, tail probabilities, fits, bootstraps, permutations and cross-fits against plain versions."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tauscope.functions.pvalues import log_gamma, regularised_beta
from tauscope.operators import resampling, spatial, spectral, stats
from tauscope.plans import ensemble


def average_rank(v):
    v = np.asarray(v, float)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


@pytest.mark.parametrize("crowded", [1024, 3])
def test_nearest_site_however_far(spark, crowded):
    rng = np.random.default_rng(1)
    sites = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 3, (60, 2)))] + [(100 + i, 5000.0, 5000.0) for i in range(4)] + [(200, None, 1.0), (201, float("nan"), 2.0)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 400, (80, 2)))] + [(i, 0.5, 0.5) for i in range(80, 95)] + [(95, -0.0, 0.0), (96, None, 1.0), (97, float("nan"), 1.0), (98, 4999.0, 5001.0)]
    p, s = spark.createDataFrame(points, "p int, x double, y double"), spark.createDataFrame(sites, "s int, x double, y double")
    got = {r.p: (r.s, r.distance) for r in spatial.nearest_join(p, "p", s, "s", 1.5, crowded=crowded).collect()}
    assert len(got) == len(points)
    for i, x, y in points:
        if x is None or x != x:
            assert got[i] == (None, None)
            continue
        best = min((math.hypot(x - a, y - b), k) for k, a, b in sites if a is not None and a == a)
        assert got[i][0] == best[1] and got[i][1] == pytest.approx(best[0], abs=1e-9)
    none = spatial.nearest_join(p, "p", s.limit(0), "s", 1.5).collect()
    assert len(none) == len(points) and all(r.s is None for r in none)
    one = spark.createDataFrame([(1, 7.0, 7.0)], "s int, x double, y double")
    assert {r.s for r in spatial.nearest_join(p.where("p = 80"), "p", one, "s", 1.5).collect()} == {1}


def test_distance_thresholds(spark):
    rng = np.random.default_rng(2)
    rows = [(float(d), float(a), float(b)) for d, a, b in zip(rng.uniform(0, 100, 60), rng.integers(1, 9, 60), rng.lognormal(size=60))] + [(1.0, -1.0, 2.0), (1.0, None, 2.0), (None, 1.0, 1.0)]
    got = {r.threshold: r for r in spatial.nearest_thresholds(spark.createDataFrame(rows, "distance double, a double, b double"), [1, 30, 80], "a", "b").collect()}
    for limit in (1, 30, 80):
        use = [(a, b) for d, a, b in rows if d is not None and a is not None and a > 0 and d <= limit]
        assert got[limit].n_pairs == len(use)
        if len(use) < 8:
            assert got[limit].rho is None
        else:
            a, b = zip(*use)
            assert got[limit].rho == pytest.approx(np.corrcoef(average_rank(np.log(a)), average_rank(np.log(b)))[0, 1])


@pytest.mark.parametrize("null_as_one", [False, True])
def test_bh_of_a_large_family(spark, null_as_one):
    rng = np.random.default_rng(3)
    rows = [(i, f"f{i % 2}" if i < 3000 else None, None if i % 50 == 0 else float(np.round(rng.random() ** 3, 3))) for i in range(3005)]
    got = {r.t: r.q_value for r in stats.bh_fdr(spark.createDataFrame(rows, "t int, f string, p double"), ["f"], "p", "t", null_as_one).collect()}
    assert len(got) == len(rows)
    for f in ("f0", "f1", None):
        own = sorted(((1.0 if p is None else p), t) for t, g, p in rows if g == f and (p is not None or null_as_one))
        least = 1.0
        for k in range(len(own), 0, -1):
            p, t = own[k - 1]
            least = min(least, p * len(own) / k)
            assert got[t] == pytest.approx(least)
    assert null_as_one or all(got[t] is None for t, _, p in rows if p is None)


def test_binomial_tail(spark):
    cases = [(0, 1), (1, 1), (0, 20), (20, 20), (3, 20), (17, 20), (480, 1000), (30, 1000), (970, 1000)]
    rows = [(g, i < k) for g, (k, n) in enumerate(cases) for i in range(n)]
    got = {r.g: r for r in stats.binomial_less(spark.createDataFrame(rows, "g int, hit boolean"), ["g"], F.col("hit")).collect()}
    for g, (k, n) in enumerate(cases):
        assert got[g].p_less == pytest.approx(sum(math.comb(n, i) for i in range(k + 1)) / 2**n, rel=1e-9)
    big = spark.createDataFrame([(10**7, 5 * 10**6 - 2000)], "n long, k long").select(regularised_beta(F.col("n") - F.col("k"), F.col("k") + 1, F.lit(0.5)).alias("p")).first().p
    assert big == pytest.approx(0.5 * math.erfc((2000 - 0.5) / math.sqrt(10**7 / 4) / math.sqrt(2)), rel=1e-4)
    lg = spark.createDataFrame([(0.5,), (1.0,), (30.25,), (1e6,)], "x double").select("x", log_gamma(F.col("x")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), rel=1e-10, abs=1e-10) for r in lg)


def test_logit_fits_of_all_predictors(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(3, 2, 300), rng.normal(-1, 5, 300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(a - 3)))).astype(int)
    rows = [(float(u), None if i % 11 == 0 else float(v), 1.0, float(w), int(w)) for i, (u, v, w) in enumerate(zip(a, b, y))] + [(1.0, 1.0, 1.0, 1.0, None)]
    got = {r.predictor: r for r in stats.logit_per_sd(spark.createDataFrame(rows, "a double, b double, c double, s double, y int"), ["a", "b", "c", "s"], "y").collect()}
    for name, column in (("a", 0), ("b", 1)):
        use = [(r[column], r[4]) for r in rows if r[column] is not None and r[4] is not None]
        x, t = np.array([u for u, _ in use]), np.array([w for _, w in use])
        z, w = np.column_stack([np.ones(len(x)), (x - x.mean()) / x.std()]), np.zeros(2)
        for _ in range(30):
            mu = 1 / (1 + np.exp(-z @ w))
            h = z.T @ (z * (mu * (1 - mu))[:, None])
            w = w + np.linalg.solve(h, z.T @ (t - mu))
        assert got[name].n == len(x) and got[name].coefficient == pytest.approx(w[1]) and got[name].std_error == pytest.approx(np.linalg.inv(h)[1, 1] ** 0.5)
        assert got[name].p_value == pytest.approx(math.erfc(abs(w[1]) / np.linalg.inv(h)[1, 1] ** 0.5 / 2**0.5))
    assert got["c"].coefficient is None and got["s"].coefficient is None  # constant; separated


def test_memory_time_over_gaps(spark):
    rng = np.random.default_rng(5)
    series = {}
    for key in ("long", "short", "gappy", "flat"):
        n = {"long": 1500, "short": 50, "gappy": 700, "flat": 200}[key]
        x = np.zeros(n)
        for i in range(1, n):
            x[i] = 0.9 * x[i - 1] + rng.normal()
        series[key] = {i: 1e6 + float(v) for i, v in enumerate(x) if key != "gappy" or rng.random() < 0.7}
        if key == "flat":
            series[key] = {i: 5.0 for i in range(n)}
    rows = [(k, i, v) for k, s in series.items() for i, v in s.items()] + [("long", 2000, None)]
    got = {r.k: r for r in spectral.tau_positive_acf(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], "i", "v").collect()}
    assert set(got) == {"long", "gappy", "flat"}
    for key in got:
        total, used, s = 0.0, 0, series[key]
        for lag in range(1, 121):
            pairs = [(s[i], s[i + lag]) for i in s if i + lag in s]
            x, y = (np.array([p[j] for p in pairs]) for j in (0, 1))
            rho = np.corrcoef(x, y)[0, 1] if len(pairs) >= 30 and x.std() * y.std() > 0 else 0.0
            if not rho > 0:
                break
            total, used = total + rho, lag
        assert got[key].lags_used == used and got[key].tau == pytest.approx(1 + 2 * total, rel=1e-6)


def drawn(spark, units, n_boot, seed):
    weights = collections.defaultdict(dict)
    for r in resampling.bootstrap_weights(spark.createDataFrame(units, "g string, u string"), ["g"], "u", n_boot, seed).collect():
        weights[r.g, r.draw][r.u] = r.weight
    return weights


def test_bootstrap_of_statistics(spark):
    rng = np.random.default_rng(6)
    rows = [(f"g{i % 2}", f"u{i}", None if i == 7 else float(np.round(rng.normal(0.2), 1))) for i in range(41)]
    df = spark.createDataFrame(rows, "g string, u string, v double")
    got = {r.g: r for r in resampling.boot_statistic(df, ["g"], "u", "v", 60, 5).collect()}
    weights = drawn(spark, [(g, u) for g, u, v in rows if v is not None], 60, 5)
    for g in ("g0", "g1"):
        value = {u: v for h, u, v in rows if h == g and v is not None}
        draws = [np.repeat([value[u] for u in w], list(w.values())) for (h, _), w in weights.items() if h == g]
        assert len(draws) == 60 and all(len(x) == len(value) for x in draws)
        for name, f in (("mean", np.mean), ("median", np.median), ("positive", lambda x: np.mean(np.asarray(x) > 0))):
            assert got[g][name] == pytest.approx(f(list(value.values()))) and got[g].n == len(value)
            assert [got[g][f"{name}_{e}"] for e in ("low", "high")] == pytest.approx(list(np.percentile([f(x) for x in draws], [2.5, 97.5])))


def test_bootstrap_of_rank_correlation(spark):
    rng = np.random.default_rng(7)
    rows = [(f"g{i % 2}", f"u{i}", float(rng.integers(0, 9)), float(rng.normal())) for i in range(50)] + [("few", "a", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, u string, x double, y double")
    got = {r.g: r for r in resampling.boot_rho(df, ["g"], "u", "x", "y", 50, 5).collect()}
    assert set(got) == {"g0", "g1"}
    weights = drawn(spark, [(g, u) for g, u, *_ in rows if g != "few"], 50, 5)
    for g in got:
        value = {u: (x, y) for h, u, x, y in rows if h == g}
        rho = lambda pairs: np.corrcoef(average_rank([p[0] for p in pairs]), average_rank([p[1] for p in pairs]))[0, 1]
        draws = [rho([value[u] for u, n in w.items() for _ in range(n)]) for (h, _), w in weights.items() if h == g]
        assert got[g].rho == pytest.approx(rho(list(value.values())))
        assert [got[g].rho_boot_median, got[g].rho_low, got[g].rho_high] == pytest.approx(list(np.percentile(draws, [50, 2.5, 97.5])))


def test_buckets_do_not_change_weighted_ranks(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(rng.integers(0, 12)), int(rng.integers(1, 4))) for i in range(60)]
    df = spark.createDataFrame(rows, "u int, v double, w int").withColumn("draw", F.lit(0))
    placed = resampling.common_buckets(df.withColumn("g", F.lit(1)), ["g"], "v", "b", size=7)
    assert placed.select("b").distinct().count() > 3
    whole = [v for _, v, w in rows for _ in range(w)]
    rank = dict(zip(whole, average_rank(whole)))
    for r in resampling.weighted_ranks(placed, ["draw"], "v", "b", "w", "r").collect():
        assert r.r == rank[r.v] and r.r_last - r.r_first + 1 == whole.count(r.v)


def test_partial_permutations(spark):
    rng = np.random.default_rng(9)
    n = 40
    c = rng.normal(size=(n, 3))
    x, y = c[:, 0] + rng.normal(size=n), c[:, 0] - c[:, 1] + rng.normal(size=n)
    rows = [(f"u{i:02d}", float(x[i]), float(np.round(y[i], 1)), float(c[i, 0]), float(np.round(c[i, 1])), None if i in (3, 9) else float(c[i, 2])) for i in range(n)]
    df = spark.createDataFrame(rows, "u string, x double, y double, a double, b double, c double")
    sets = {"none": [], "ab": ["a", "b"], "abc": ["a", "b", "c"], "twice": ["a", "a"]}
    got = {r.controls: r for r in resampling.perm_partial(df, "u", "x", "y", sets, 25, 11).collect()}

    def partial(xr, yr, cr):
        z = np.column_stack([np.ones(len(xr)), *cr])
        rest = [v - z @ np.linalg.lstsq(z, v, rcond=None)[0] for v in (xr, yr)]
        return np.corrcoef(*rest)[0, 1]

    for name, cs in sets.items():
        use = [r for r in rows if name != "abc" or r[5] is not None]
        at = {"x": 1, "y": 2, "a": 3, "b": 4, "c": 5}
        rank = {k: average_rank([r[at[k]] for r in use]) for k in ("x", "y", *cs)}
        observed = partial(rank["x"], rank["y"], [rank[k] for k in cs])
        ids = [r[0] for r in use]
        frame = spark.createDataFrame(list(zip(ids, map(float, rank["y"]))), "u string, y double").withColumn("controls", F.lit(name))
        moved = collections.defaultdict(dict)
        for r in resampling.permuted(frame, ["controls"], "u", "y", 25, 11, "p").collect():
            moved[r.draw][r.u] = r.p
        draws = [partial(rank["x"], np.array([m[u] for u in ids]), [rank[k] for k in cs]) for m in moved.values()]
        assert got[name].n == len(use) and got[name].n_perm == 25 and got[name].partial_rho == pytest.approx(observed)
        assert got[name].p_value == pytest.approx((sum(abs(d) >= abs(observed) - 1e-12 for d in draws) + 1) / 26)


def test_memory_of_the_other_segments(spark):
    rows = [("a", "g", s, t) for s, t in enumerate([5.0, 1.0, 9.0, 9.0])] + [("a", "h", 0, 2.0), ("a", "h", 1, 4.0), ("a", "lone", 0, 1.0)]
    df = spark.createDataFrame(rows, "archive string, gauge_id string, s int, tau double")
    got = {(r.gauge_id, r.s): r.tau for r in resampling.crossfit_tau(df, ["archive", "gauge_id"], "s").collect()}
    want = {(g, s): float(np.median([t for _, h, o, t in rows if h == g and o != s])) for _, g, s, _ in rows if g != "lone"}
    assert got == want


def test_segments_that_count(spark):
    day = lambda n: f"date_add(date'2000-01-01', {n})"
    parts = [("whole", 0, 0, 1), ("whole", 1, 900, 1), ("gaps", 0, 0, 1), ("gaps", 1, 900, 3), ("short", 0, 0, 1)]
    sql = " UNION ALL ".join(f"SELECT '{g}' AS gauge_id, {s} AS seg, {day(f'cast({start} + id AS int)')} AS day, 1.0D AS q FROM range(0, 800, {step})" for g, s, start, step in parts)
    kept = ensemble.valid_segments(spark.sql(sql), ["gauge_id"], "seg", 2, 2.0, 0.1).select("gauge_id").distinct().collect()
    assert [r.gauge_id for r in kept] == ["whole"]
