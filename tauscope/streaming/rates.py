"""Event rates on a stream: the batch rate without its zero-filled bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_event_rate(
    events: DataFrame, keys: Sequence[str], time: str, width: str = "1 hour", lateness: str = "2 hours"
) -> DataFrame:
    """Counts per key and tumbling window; rows later than the watermark are dropped.

    State holds one counter per open (key, window), bounded by the watermark.
    """
    stamped = events.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", lateness)
    counts = stamped.groupBy(F.window("_ts", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*keys, F.col("w.start").alias("time"), F.col("n").cast("double").alias("value"))


def run_available(
    rates: DataFrame, path: str, checkpoint: str, spark: SparkSession, partition: Sequence[str] = ()
) -> DataFrame:
    """Process what has arrived into Parquet with an exactly-once file sink and return it."""
    query = (
        rates.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).partitionBy(*partition).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(path)
