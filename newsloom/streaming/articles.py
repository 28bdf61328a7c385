"""Streaming extension: raw landings as a stream, late items by watermark, links once, weekly counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonical_url


def first_links(stream: DataFrame, time: str = "date", link: str = "link", lateness: str = "1 day") -> DataFrame:
    """Each canonical link once while its events are within the watermark. Undated rows have no event time and are left out here."""
    dated = stream.where(F.col(time).isNotNull()).withColumn("canonical", canonical_url(F.col(link)))
    return dated.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["canonical"])


def weekly_counts(stream: DataFrame, time: str = "date", key: str = "country", lateness: str = "1 day") -> DataFrame:
    """Rows per key and week from Sunday to Saturday."""
    weeks = F.window(F.col(time), "7 days", startTime="3 days").alias("week")  # the epoch is a Thursday
    counted = stream.withWatermark(time, lateness).groupBy(weeks, F.col(key)).agg(F.count("*").alias("n"))
    return counted.select(F.col("week.start").alias("week_start"), key, "n")
