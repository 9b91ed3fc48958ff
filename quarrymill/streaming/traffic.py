"""The tool-traffic log as a stream: windows with a watermark, and call/result pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def pairs(calls: DataFrame, results: DataFrame, patience: str = "1 hour") -> DataFrame:
    """``calls (id, ts, ...)`` with ``results (id, ts, ...)`` that come within ``patience``; late ones give nulls."""
    c = calls.withWatermark("ts", patience).alias("c")
    r = results.withWatermark("ts", patience).alias("r")
    near = F.expr(f"c.id = r.id AND r.ts BETWEEN c.ts AND c.ts + INTERVAL {patience}")
    return c.join(r, near, "left")
