"""Cross-fits on packed segments: the segments and the edges of dealt draws as the tables of rows give them."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tauscope.operators import binning, prep
from tauscope.plans import ensemble


def near(got, want, by, columns):
    got, want = (df.toPandas().sort_values(by).reset_index(drop=True) for df in (got, want))
    assert len(got) == len(want) > 0 and (got[by].astype(str) == want[by].astype(str)).all().all()
    assert np.allclose(got[columns].astype(float), want[columns].astype(float), equal_nan=True, rtol=1e-9, atol=1e-12)


def test_edges_of_dealt_draws_with_unlike_frequencies(spark):
    rng = np.random.default_rng(3)
    units, deals = [], []
    for fold in ("p", "q"):
        taus = rng.uniform(1, 50, size=12)
        for u in range(12):
            ks = [k / 64 for k in range(1, 33) if not (u in (3, 7) and k % 5 == 0) and not (k > 30 and u != 3)]
            units.append((fold, f"{fold}{u}", ks, float(taus[u])))
        for draw in range(3):
            deals += [(fold, f"{fold}{u}", draw, float(t)) for u, t in enumerate(rng.permutation(taus))]
    points = spark.createDataFrame(units, "fold string, unit string, ks array<double>, tau double")
    dealt = spark.createDataFrame(deals, "fold string, unit string, draw int, _tau double")
    fits = points.withColumn("analysis_group", F.explode(F.array(F.lit("all"), F.col("fold"))))
    got = ensemble.dealt_edges(fits, dealt, ["analysis_group"], 3, 0.025, 0.975, 24)
    every = fits.join(dealt, ["fold", "unit"]).select("analysis_group", "draw", F.col("_tau"), F.explode("ks").alias("f"))
    want = binning.bin_edges(every.withColumn("x", F.log10(F.col("f") * F.col("_tau"))), ["analysis_group", "draw"], 0.025, 0.975, 24)
    near(got, want, ["analysis_group", "draw"], ["lo", "width"])


def test_packed_segments_match_the_rows(spark):
    first = dt.date(1999, 11, 3)
    rows = [(f"g{n}", first + dt.timedelta(days=i), float(i % 7)) for n in (9, 10, 13) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, day date, q double")
    packed = prep.daily_series(df, ["g"], "day", "q")
    for parts, want, name in (
        (prep.packed_halves(packed), prep.split_half(df, ["g"], "day"), "segment"),
        (prep.packed_blocks(packed, 4), prep.split_blocks(df, ["g"], "day", 4), "block"),
    ):
        got = {(r.g, str(r.segment)): (r.first, len(r.xs)) for r in parts.select("g", F.inline("parts")).collect()}
        want = want.groupBy("g", name).agg(F.min(F.unix_date("day")), F.count("q")).collect()
        assert got == {(r[0], str(r[1])): (r[2], r[3]) for r in want}
