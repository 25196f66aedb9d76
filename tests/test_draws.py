"""Bootstraps of small groups are drawn from one array; they equal the draws through buckets."""

import numpy as np
import pytest

from tauscope.operators import resampling as rs


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    own = [("one" if i < 30 else "twice", f"u{i % 30}", float(rng.integers(0, 9)), float(rng.normal())) for i in range(45)] + [("twice", "u1", 3.0, 4.0)]
    return spark.createDataFrame(own, "g string, u string, _x double, _y double").cache()


def test_draws_of_whole_and_bucketed_groups(spark, rows):
    names, seen = ["mean", "median", "positive"], []
    bucketed = lambda some: rs.bucketed_statistics(some, ["g"], "u", "_y", 103, 5)
    ways = [rs.all_draws(rows, ["g"], "u", ["_y"], names, 103, 5, rs.plain_statistics, lambda some: seen.append({r.g for r in some.select("g").distinct().collect()}) or bucketed(some), whole) for whole in (99, 0)]
    assert seen == [{"twice"}, {"one", "twice"}]  # units with several rows are never one array
    a, b = (w.orderBy("g", "draw").toPandas() for w in ways)
    assert len(a) == len(b) == 206 and (a[["g", "draw"]] == b[["g", "draw"]]).all().all() and np.allclose(a[names], b[names])
