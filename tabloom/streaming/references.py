"""A stream of references against the visuals recorded so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_references(stream: DataFrame, visuals: DataFrame) -> DataFrame:
    """References of a stream whose visual has no row at all. ``visuals`` is a batch table; Spark keeps no state for it."""
    known = visuals.select(F.col("visual_id").alias("resolved_visual_id")).where("resolved_visual_id is not null").distinct()
    wanted = stream.where("resolution_status = 'resolved' and resolved_visual_id is not null")
    return wanted.join(known, "resolved_visual_id", "left_anti")


def counts_by_month(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """References per paper and window of 30 days of observed_at (a TIMESTAMP); rows later than ``delay`` are let go."""
    timed = stream.withColumn("seen", F.col("observed_at").cast("timestamp")).withWatermark("seen", delay)
    return timed.groupBy("paper_id", F.window("seen", "30 days")).agg(F.count("*").alias("n_references")).select("paper_id", F.col("window.start").alias("starts"), "n_references")
