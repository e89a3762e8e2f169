"""Snapping downbeats to the nearest beat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mark_beats(times: DataFrame) -> DataFrame:
    """(piece_id, time, is_beat, is_down) from (piece_id, kind, time): kind 0 is a beat, 1 a downbeat, null an anchor (kept as neither).

    A downbeat marks the nearest beat of its piece, the earlier of two equally near, and is gone; in a piece without beats it
    stays as it is.  One sort by piece and time replaces a join: of the downbeats between two beats only the nearest to a beat
    can decide whether the beat is marked.
    """
    rows = times.select("piece_id", "kind", "time", F.when(F.col("kind") == 0, F.col("time")).alias("beat"), F.when(F.col("kind") == 1, F.col("time")).alias("down"))
    near = lambda f, c: F.expr(f"{f}({c}) IGNORE NULLS OVER (PARTITION BY piece_id ORDER BY time, kind DESC)").alias(f"{f}_{c}")
    alone = F.expr("max(beat) OVER (PARTITION BY piece_id)").isNull()
    rows = rows.select("*", near("lag", "beat"), near("lag", "down"), near("lead", "beat"), near("lead", "down"), alone.alias("alone"))
    t, before, after = F.col("time"), F.col("lag_beat"), F.col("lead_beat")
    left, right = F.col("lag_down"), F.col("lead_down")
    from_left = left.isNotNull() & (before.isNull() | (left > before) & (t - left < left - before))
    from_right = right.isNotNull() & (after.isNull() | (right < after) & (right - t <= after - right))
    is_beat = F.coalesce(F.col("kind") == 0, F.lit(False))
    is_down = F.when(is_beat, from_left | from_right).otherwise(F.coalesce(F.col("kind") == 1, F.lit(False)) & F.col("alone"))
    return rows.select("piece_id", "time", is_beat.alias("is_beat"), F.coalesce(is_down, F.lit(False)).alias("is_down"), "kind").where("is_beat or is_down or kind is null").drop("kind")


def snap_downbeats(beats: DataFrame, downbeats: DataFrame) -> DataFrame:
    """(piece_id, time): each downbeat moved to the nearest beat of its piece, the earlier of two equally near; distinct.

    A piece without beats keeps its downbeats as they are, repeats included.
    """
    both = beats.select("piece_id", "time").distinct().withColumn("kind", F.lit(0)).unionByName(downbeats.select("piece_id", "time", F.lit(1).alias("kind")))
    return mark_beats(both).where("is_down").select("piece_id", "time")
