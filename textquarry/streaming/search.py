"""Search over streams: what works a row at a time needs no state; counts over time need a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions import text as T


def count_stream(stream: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """The stream's matching rows with n, the number of matches."""
    return stream.where(F.col(text).contains(pattern)).withColumn("n", T.count_overlapping(text, pattern))


def record_stream(stream: DataFrame, pattern: str, boundary: str = "\n", text: str = "text") -> DataFrame:
    """One row for each record that holds the pattern."""
    rows = stream.where(F.col(text).contains(pattern)).withColumn("record", F.explode(F.split(F.col(text), f"\\Q{boundary}\\E")))
    return rows.where(F.col("record").contains(pattern))


def windowed_counts(stream: DataFrame, pattern: str, time: str, text: str = "text", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Matches in each window of event time; rows later than the watermark are left out."""
    rows = count_stream(stream.withWatermark(time, late), pattern, text)
    return rows.groupBy(F.window(time, width)).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_rows")).select(F.col("window.start").alias("start"), "n", "n_rows")
