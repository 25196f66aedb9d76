"""Results that are put together from small written tables."""

import io
from contextlib import redirect_stdout

import numpy as np
from pyspark.sql import functions as F

from tauscope.operators import spatial, stats


def test_points_at_one_place_meet_its_polygons_once(spark, monkeypatch):
    points = spark.range(200).select(F.col("id").alias("p"), (F.col("id") % 7 / 2.0).alias("x"), F.when(F.col("id") != 3, F.col("id") % 3 / 1.0).alias("y"))
    sides = [(g, *e) for g in range(4) for e in ((0.0, 0.0, g + 0.5, 0.0), (g + 0.5, 0.0, g + 0.5, 1.5), (g + 0.5, 1.5, 0.0, 1.5), (0.0, 1.5, 0.0, 0.0))]
    edges = spark.createDataFrame(sides, "g int, x1 double, y1 double, x2 double, y2 double")
    want = sorted(map(tuple, spatial.point_in_polygon(points, "p", edges, "g", 1.0).collect()))
    seen = []
    monkeypatch.setattr(spatial, "point_in_polygon", lambda places, *a, f=spatial.point_in_polygon: seen.append(places.count()) or f(places, *a))
    assert sorted(map(tuple, spatial.point_in_polygon_by_place(points, "p", edges, "g", 1.0).collect())) == want and len(want) > 200
    assert seen == [21]


def test_adjusted_associations_do_not_carry_the_ranks(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(40, 3))], "t double, a double, b double")
    found, out = stats.attribute_spearman(rows, ["a", "b"], "t"), io.StringIO()
    with redirect_stdout(out):
        found.explain("formatted")
    assert "Generate" not in out.getvalue() and found.count() == 2


def test_mean_slopes_come_from_a_row(spark):
    from catalog import base

    folder = "/root/testdata/sf0.001"
    want = {r.gauge_id: r.b for r in base.curve(spark, folder).groupBy("gauge_id").agg(F.avg("beta").alias("b")).collect()}
    got = {r.gauge_id: r.b for r in base.gauge_means(spark, folder).collect()}
    assert got.keys() == want.keys() and got and all(np.isclose(got[k], want[k]) for k in want)
