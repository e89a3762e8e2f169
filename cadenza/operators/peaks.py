"""From per-frame scores to beat times: sliding maximum, peak merging, frames to seconds.

Input: logits (piece_id, frame, beat, downbeat).  A piece may be of any length: the sliding maximum runs over
blocks of frames with a halo, so that one long piece is many tasks.  From the peaks on, one in some fifty frames, a piece is
one task's: its peaks are sorted by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import FPS, PEAK_REACH

BLOCK = 1 << 16
SCORES = ("beat", "downbeat")


def find_all_peaks(logits: DataFrame, scores: tuple[str, ...] = SCORES, reach: int = PEAK_REACH, block: int = BLOCK, anchors: bool = False) -> DataFrame:
    """(piece_id, kind, frame) of the peaks of each score, in one pass; kind is the score's place in `scores`.

    A peak's score is above zero and no score within `reach` frames is larger; ties all count.  A NaN score is a peak and hides
    no other.  anchors: with rows of kind null, at least one a piece, so that pieces without peaks are not lost.
    """
    own = F.floor(F.col("frame") / block)
    reachable = F.array_distinct(F.array(own, F.floor((F.col("frame") - reach) / block), F.floor((F.col("frame") + reach) / block)))
    spread = logits.select("piece_id", "frame", *[F.col(s).alias(f"x{k}") for k, s in enumerate(scores)], own.alias("own"), F.explode(reachable).alias("block"))
    by = Window.partitionBy("piece_id", "block").orderBy("frame")
    top = [F.max(F.nanvl(f"x{k}", F.lit(float("-inf")))).over(by.rowsBetween(-reach, reach)).alias(f"top{k}") for k in range(len(scores))]
    seen = spread.select("*", *top, F.lag("frame").over(by).isNull().alias("anchor")).where(F.col("own") == F.col("block"))
    peak = lambda k: F.isnan(f"x{k}") | (F.col(f"x{k}") > 0) & (F.col(f"x{k}") == F.col(f"top{k}"))
    kinds = F.array_compact(F.array(*[F.when(peak(k), F.lit(k)) for k in range(len(scores))]))
    kinds = F.when(F.col("anchor"), F.concat(kinds, F.array(F.lit(None).cast("int")))).otherwise(kinds) if anchors else kinds
    return seen.select("piece_id", "frame", F.explode(kinds).alias("kind")).select("piece_id", "kind", "frame")


def find_peaks(logits: DataFrame, score: str, reach: int = PEAK_REACH, block: int = BLOCK) -> DataFrame:
    """(piece_id, frame) of the peaks of one score."""
    return find_all_peaks(logits, (score,), reach, block).select("piece_id", "frame")


def merge_peaks(peaks: DataFrame, *kind: str) -> DataFrame:
    """(piece_id, kind, position): adjacent peaks of a kind merge in pairs, to the mean of the two (a merging width of one frame).

    One sort: a run of adjacent frames starts where the frame before is missing, and every second of its peaks joins the one before.
    """
    by = Window.partitionBy("piece_id", *kind).orderBy("frame")
    starts = F.coalesce(F.col("frame") - F.lag("frame").over(by) != 1, F.lit(True))
    rows = peaks.select("piece_id", *kind, "frame", F.row_number().over(by).alias("n"), starts.alias("starts"), (F.lead("frame").over(by) - F.col("frame") == 1).alias("joined"))
    first = F.max(F.when(F.col("starts"), F.col("n"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("place", F.col("n") - first).where(F.col("place") % 2 == 0)
    return rows.select("piece_id", *kind, (F.col("frame") + F.when(F.col("joined"), 0.5).otherwise(0.0)).alias("position"))


def merge_sorted(frames: Column, width: float = 1.0) -> Column:
    """The same for an array of sorted frames and any width: a frame joins the group while it is within `width` of its mean."""
    start = F.struct(F.array().cast("array<double>").alias("done"), F.lit(0.0).cast("double").alias("sum"), F.lit(0).alias("n"))

    def step(acc, x):
        x = x.cast("double")
        joins = (acc.n > 0) & (x - acc["sum"] / acc.n <= width)
        return F.when(joins, F.struct(acc.done.alias("done"), (acc["sum"] + x).alias("sum"), (acc.n + 1).alias("n"))).otherwise(
            F.struct(F.when(acc.n > 0, F.concat(acc.done, F.array(acc["sum"] / acc.n))).otherwise(acc.done).alias("done"), x.alias("sum"), F.lit(1).alias("n"))
        )

    return F.aggregate(frames, start, step, lambda acc: F.when(acc.n > 0, F.concat(acc.done, F.array(acc["sum"] / acc.n))).otherwise(acc.done))


def to_seconds(position: Column, fps: float = FPS) -> Column:
    """Frames to seconds, divided as double and kept as float."""
    return (position.cast("double") / F.lit(float(fps))).cast("float")


def peak_times(logits: DataFrame, score: str, fps: float = FPS) -> DataFrame:
    """(piece_id, time) of the merged peaks of one score."""
    return merge_peaks(find_peaks(logits, score)).select("piece_id", to_seconds(F.col("position"), fps).alias("time"))


def all_times(logits: DataFrame, scores: tuple[str, ...] = SCORES, fps: float = FPS, anchors: bool = False) -> DataFrame:
    """(piece_id, kind, time) of the merged peaks of all scores; anchors as in find_all_peaks."""
    merged = merge_peaks(find_all_peaks(logits, scores, anchors=anchors), "kind")
    return merged.select("piece_id", "kind", F.when(F.col("kind").isNotNull(), to_seconds(F.col("position"), fps)).alias("time"))
