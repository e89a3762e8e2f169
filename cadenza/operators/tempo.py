"""Beat intervals and tempo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import INTERVAL_HIGH, INTERVAL_LOW


def valid_interval(interval: Column) -> Column:
    """Strictly between 0.1 and 3 seconds."""
    return (interval > F.lit(INTERVAL_LOW).cast("float")) & (interval < F.lit(INTERVAL_HIGH).cast("float"))


def bpm_of(median: Column) -> Column:
    """Beats a minute of a median interval; null of null."""
    return (F.lit(60.0) / median.cast("float")).cast("float")


def beat_intervals(beats: DataFrame) -> DataFrame:
    """(piece_id, time, interval) of the intervals to the previous beat that lie strictly between 0.1 and 3 seconds."""
    gap = F.col("time") - F.lag("time").over(Window.partitionBy("piece_id").orderBy("time"))
    return beats.select("piece_id", "time", gap.alias("interval")).where(valid_interval(F.col("interval")))


def median_bpm(beats: DataFrame, pieces: DataFrame | None = None) -> DataFrame:
    """(piece_id, bpm): 60 by the median interval, null without a valid one.  pieces: the pieces to list, beats or not."""
    tempo = beat_intervals(beats).groupBy("piece_id").agg(bpm_of(F.median("interval")).alias("bpm"))
    return (pieces if pieces is not None else beats).select("piece_id").distinct().join(tempo, "piece_id", "left")
