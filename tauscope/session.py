"""Session defaults shared by tests, benchmark and notebooks."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tauscope", cpus: str | int | None = None, **conf: str) -> SparkSession:
    """Return a session with UTC time, adaptive execution and Arrow transfer.

    On a cluster the master, the shuffle width and ``spark.checkpoint.dir`` come from
    spark-submit; ``cpus`` only selects a local master for tests.
    """
    builder = SparkSession.builder.appName(app)
    if cpus is not None:
        builder = builder.master(f"local[{cpus}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one next to the warehouse where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or os.path.join(spark.conf.get("spark.sql.warehouse.dir").replace("file:", ""), "_checkpoints")


def materialise(df):
    """Cut the lineage of ``df`` through the cluster's reliable checkpoint folder.

    ``spark.checkpoint.dir`` names shared storage on a cluster, so a lost executor only
    re-reads files. Without it (tests) a folder is created next to the warehouse.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
