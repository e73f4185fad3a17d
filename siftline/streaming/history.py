"""Run statistics over a stream of runs: the batch reports as incremental aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_counts(runs: DataFrame, ts: str = "ts", status: str = "status", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Runs and mean score by window and status; rows later than `late` are left out, and closed windows leave the state."""
    return runs.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), status).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("window_start"), status, "n", "mean_value")


def keyword_counts(runs: DataFrame, ts: str = "ts", late: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """Missing keywords by window."""
    each = runs.withWatermark(ts, late).select(ts, F.explode("not_in_master").alias("keyword"))
    return each.groupBy(F.window(ts, window).alias("w"), "keyword").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "keyword", "n")
