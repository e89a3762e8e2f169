"""Beat numbers inside measures, with pickup measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_marked(marked: DataFrame) -> DataFrame:
    """marked (piece_id, time, is_beat, is_down) with beat: 1 on each downbeat, then counting up; null on rows that are no beats.

    Beats before the first downbeat count up to it if there are two downbeats or more and the pickup is shorter than the first
    measure; otherwise they count from 2.  All windows share one order.
    """
    by = Window.partitionBy("piece_id").orderBy("time")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    piece = Window.partitionBy("piece_id")
    down = F.col("is_beat") & F.col("is_down")
    placed = marked.withColumn("rank", F.count_if("is_beat").over(so_far) - 1).withColumn("measure", F.count_if(down).over(so_far))
    start = lambda k: F.min(F.when(down & (F.col("measure") == k), F.col("rank"))).over(piece)
    placed = placed.withColumn("first", start(1)).withColumn("second", start(2)).withColumn("last", F.max(F.when(down, F.col("rank"))).over(so_far))
    length = F.col("second") - F.col("first")
    pickup = F.when(F.col("second").isNotNull() & (F.col("first") < length), length - F.col("first")).otherwise(F.lit(1))
    beat = F.col("rank") + 1 + F.when(F.col("measure") == 0, pickup).otherwise(-F.col("last"))
    return placed.withColumn("beat", F.when(F.col("is_beat"), beat).cast("int")).drop("rank", "measure", "first", "second", "last")


def number_beats(beats: DataFrame, downbeats: DataFrame) -> DataFrame:
    """(piece_id, time, beat, downbeat) of every beat; downbeats must be beats (as snap_downbeats leaves them)."""
    downs = downbeats.select("piece_id", "time").distinct().withColumn("is_down", F.lit(True))
    marked = beats.select("piece_id", "time", F.lit(True).alias("is_beat")).join(downs, ["piece_id", "time"], "left").fillna(False, ["is_down"])
    return number_marked(marked).select("piece_id", "time", "beat", (F.col("beat") == 1).alias("downbeat"))
