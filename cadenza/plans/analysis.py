"""The analysis as one plan: recordings to beats, measures and tempo."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import FPS
from ..operators.align import mark_beats
from ..operators.chunking import Model, predict
from ..operators.features import mel_frames
from ..operators.meter import number_marked
from ..operators.peaks import all_times
from ..operators.tempo import bpm_of, valid_interval


def mark_logits(logits: DataFrame, fps: float = FPS, anchors: bool = False) -> DataFrame:
    """(piece_id, time, is_beat, is_down) of (piece_id, frame, beat, downbeat): both scores' peaks, in one pass."""
    return mark_beats(all_times(logits, fps=fps, anchors=anchors))


def decode_logits(logits: DataFrame, fps: float = FPS) -> tuple[DataFrame, DataFrame]:
    """(beats, downbeats), each (piece_id, time); downbeats lie on beats."""
    marked = mark_logits(logits, fps)
    return marked.where("is_beat").select("piece_id", "time"), marked.where("is_down").select("piece_id", "time")


def decode_arrays(beat: list[float], downbeat: list[float], spark, fps: float = FPS) -> tuple[list[float], list[float]]:
    """The same for one piece given as two lists, which must be equally long."""
    if len(beat) != len(downbeat):
        raise ValueError(f"scores of different length: {len(beat)} and {len(downbeat)}")
    rows = [(0, i, float(b), float(d)) for i, (b, d) in enumerate(zip(beat, downbeat, strict=True))]
    beats, downs = decode_logits(spark.createDataFrame(rows, "piece_id int, frame int, beat float, downbeat float"), fps)
    return tuple(sorted(r.time for r in x.collect()) for x in (beats, downs))


def number_logits(logits: DataFrame, fps: float = FPS) -> DataFrame:
    """(piece_id, time, beat, downbeat) of every beat."""
    return number_marked(mark_logits(logits, fps).where("is_beat")).select("piece_id", "time", "beat", (F.col("beat") == 1).alias("downbeat"))


def analyze_logits(logits: DataFrame, fps: float = FPS) -> DataFrame:
    """results (piece_id, beats, downbeats, bpm), a row a piece, from one scan and one grouping."""
    rows = number_marked(mark_logits(logits, fps, anchors=True))
    rows = rows.withColumn("interval", F.when(F.col("is_beat"), F.col("time") - F.expr("lag(IF(is_beat, time, NULL)) IGNORE NULLS OVER (PARTITION BY piece_id ORDER BY time)")))
    return rows.groupBy("piece_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_beat"), F.struct("time", "beat", (F.col("beat") == 1).alias("downbeat"))))).alias("beats"),
        F.array_sort(F.collect_list(F.when(F.col("is_down"), F.col("time")))).alias("downbeats"),
        bpm_of(F.median(F.when(valid_interval(F.col("interval")), F.col("interval")))).alias("bpm"),
    )


def with_empty(pcm: DataFrame, found: DataFrame) -> DataFrame:
    """results of all pieces of pcm: those that found lacks keep a row without beats."""
    out = pcm.select("piece_id").distinct().join(found, "piece_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c)
    return out.select("piece_id", empty("beats"), empty("downbeats"), "bpm")


def analyze(pcm: DataFrame, make_model: Callable[[], Model]) -> DataFrame:
    """results of pcm (piece_id, sample_rate, samples); pieces without frames keep a row without beats."""
    frames = mel_frames(pcm.where(F.col("samples").isNotNull()))
    return with_empty(pcm, analyze_logits(predict(frames, make_model)))


def analyze_timed(pcm: DataFrame, make_model: Callable[[], Model]) -> tuple[DataFrame, dict[str, float]]:
    """results, and the seconds that mel frames, the model and the decoding took, each computed and kept before the next."""
    seconds, began = {}, time.perf_counter()

    def done(name: str, df: DataFrame) -> DataFrame:
        nonlocal began
        df = df.persist(StorageLevel.DISK_ONLY)
        df.count()
        seconds[name], began = time.perf_counter() - began, time.perf_counter()
        return df

    frames = done("mel", mel_frames(pcm.where(F.col("samples").isNotNull())))
    logits = done("predict", predict(frames, make_model))
    found = done("decode", with_empty(pcm, analyze_logits(logits)))
    frames.unpersist()
    logits.unpersist()
    return found, seconds
