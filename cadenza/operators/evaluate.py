"""Scores against reference annotations, comparisons, and batch totals."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import EVALUATION_WINDOW, POSITION_TOLERANCE


def _by_piece(reference: DataFrame, estimated: DataFrame, fn, schema: str) -> DataFrame:
    kind = reference.schema["piece_id"].dataType.simpleString()
    return reference.select("piece_id", "time").groupBy("piece_id").cogroup(estimated.select("piece_id", "time").groupBy("piece_id")).applyInPandas(fn, f"piece_id {kind}, {schema}")


def match_sorted(r: list[float], e: list[float], window: float) -> list[tuple[int, int]]:
    """Pairs (reference, estimate) of two sorted lists: both move on at a match within the window, else the smaller."""
    out, i, j = [], 0, 0
    while i < len(r) and j < len(e):
        if abs(r[i] - e[j]) <= window:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif r[i] < e[j]:
            i += 1
        else:
            j += 1
    return out


def f_measure(reference: DataFrame, estimated: DataFrame, window: float = EVALUATION_WINDOW) -> DataFrame:
    """One row a piece: f_measure, matched, n_ref, n_est, max_matched_diff, mean_matched_diff; 0 where undefined."""

    def score(key, ref, est):
        piece = ref if len(ref) else est
        r, e = sorted(map(float, ref.time)), sorted(map(float, est.time))
        diffs = [abs(r[i] - e[j]) for i, j in match_sorted(r, e, window)]
        m = len(diffs)
        precision, recall = m / len(e) if e else 0.0, m / len(r) if r else 0.0
        f = 2 * precision * recall / (precision + recall) if m else 0.0
        return pd.DataFrame({"piece_id": [piece.piece_id.iloc[0]], "f_measure": [f], "matched": [m], "n_ref": [len(r)], "n_est": [len(e)], "max_matched_diff": [max(diffs, default=0.0)], "mean_matched_diff": [sum(diffs) / m if m else 0.0]})

    return _by_piece(reference, estimated, score, "f_measure double, matched long, n_ref long, n_est long, max_matched_diff double, mean_matched_diff double")


def nearest_match(reference: DataFrame, estimated: DataFrame, tolerance: float) -> DataFrame:
    """One row a piece: each reference time takes the nearest unused estimate within the tolerance, in order of time."""

    def score(key, ref, est):
        piece = ref if len(ref) else est
        r, free = sorted(map(float, ref.time)), sorted(map(float, est.time))
        n_test, diffs = len(free), []
        for t in r:
            k = bisect.bisect_left(free, t)
            near = [i for i in (k - 1, k) if 0 <= i < len(free)]
            best = min(near, key=lambda i: (abs(free[i] - t), i), default=None)
            if best is not None and abs(free[best] - t) <= tolerance:
                diffs.append(abs(free.pop(best) - t))
        m = len(diffs)
        return pd.DataFrame({"piece_id": [piece.piece_id.iloc[0]], "ref_count": [len(r)], "test_count": [n_test], "matched": [m], "missed": [len(r) - m], "spurious": [n_test - m], "max_deviation_ms": [1000 * max(diffs, default=0.0)], "mean_deviation_ms": [1000 * sum(diffs) / m if m else 0.0]})

    return _by_piece(reference, estimated, score, "ref_count long, test_count long, matched long, missed long, spurious long, max_deviation_ms double, mean_deviation_ms double")


def compare_positions(left: DataFrame, right: DataFrame, tolerance: float = POSITION_TOLERANCE) -> DataFrame:
    """(piece_id, position, left_time, left_beat, right_time, right_beat) of the beats that differ, position by position."""
    by = Window.partitionBy("piece_id").orderBy("time")
    number = lambda df, side: df.select("piece_id", (F.row_number().over(by) - 1).alias("position"), F.col("time").alias(f"{side}_time"), F.col("beat").alias(f"{side}_beat"))
    both = number(left, "left").join(number(right, "right"), ["piece_id", "position"], "full")
    off = F.abs(F.col("left_time").cast("double") - F.col("right_time").cast("double")) > tolerance
    return both.where(F.coalesce(off | (F.col("left_beat") != F.col("right_beat")), F.lit(True)))


def largest_difference(a: Column, b: Column) -> Column:
    """Largest absolute difference, as an aggregate."""
    return F.max(F.abs(a - b))


def batch_summary(files: DataFrame, model_seconds: float = 0.0) -> DataFrame:
    """One row from (duration_secs, processing_time_secs, failed): counts, and sums over the files that succeeded."""
    good = ~F.col("failed")
    total = lambda c: F.coalesce(F.sum(F.when(good, F.col(c).cast("double"))), F.lit(0.0))
    sums = files.agg(F.count("*").alias("total_files"), F.count_if("failed").alias("failed_files"), total("duration_secs").alias("d"), total("processing_time_secs").alias("p"))
    return sums.select(
        "total_files", "failed_files", F.col("d").cast("float").alias("total_duration_secs"), F.col("p").cast("float").alias("total_processing_time_secs"),
        F.lit(float(model_seconds)).cast("float").alias("model_loading_time_secs"), F.when(F.col("p") > 0, F.col("d") / F.col("p")).otherwise(F.lit(0.0)).cast("float").alias("realtime_factor"),
    )


def speedup(runs: DataFrame, baseline: str) -> DataFrame:
    """(runtime, seconds, speedup) from (runtime, seconds) of single runs: sums, and the baseline's sum by each."""
    total = runs.groupBy("runtime").agg(F.sum("seconds").alias("seconds"))
    base = total.where(F.col("runtime") == baseline).select(F.col("seconds").alias("base"))  # one row
    return total.join(F.broadcast(base)).select("runtime", "seconds", F.when(F.col("seconds") > 0, F.col("base") / F.col("seconds")).alias("speedup"))
