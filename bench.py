"""Time headline queries on the benchmark tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "src_nwis_json", "event_rate", "anomaly_us", "tau_integral", "welch_psd", "de_coordinate", "lomb_scargle",
    "reduction", "boot_gauge_reduction", "null_seasonal", "bh_fdr", "cq_relation", "nse_kge", "nearest_join",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    import catalog
    from catalog.base import forget
    from tauscope.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", cpus,
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    times = {}
    for name in HEADLINE:
        forget()  # every query starts from the source files
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").split("sf")[-1],
    }))


if __name__ == "__main__":
    main()
