"""Overlapping chunks of frames for a model with bounded context, and the merge of its outputs.

A piece of T frames is cut to ceil(T / 1488) chunks of up to 1500 frames that overlap by a border of 6 on either side.
After the model the borders go, and each frame is taken from the earliest chunk that has it: chunk frame // 1488.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BORDER, CHUNK, STRIDE


class Model(Protocol):
    """Scores of a batch of equally long chunks: (batch, frames, bands) -> two arrays (batch, frames)."""

    def __call__(self, frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]: ...


def chunk_start(chunk: Column, total: Column) -> Column:
    """First frame of a chunk; the last of a long piece is moved back to end at its border."""
    regular = chunk * STRIDE - BORDER
    last = (chunk == F.ceil(total / STRIDE) - 1) & (total > STRIDE)
    return F.when(last, total - (CHUNK - BORDER)).otherwise(regular).cast("int")


def chunk_starts(lengths: DataFrame) -> DataFrame:
    """(piece_id, chunk, start) from (piece_id, total); a piece without frames has no chunk."""
    chunks = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("total") / STRIDE) - 1).cast("int")))
    return lengths.where("total > 0").select("piece_id", "total", chunks.alias("chunk")).select("piece_id", "chunk", chunk_start(F.col("chunk"), F.col("total")).alias("start"))


def chunk_size(start: Column, total: Column) -> Column:
    """Frames of a chunk with its zero padding: 1500, or all of a shorter piece and its borders."""
    left = F.greatest(F.lit(0), -start)
    right = F.greatest(F.lit(0), F.least(F.lit(BORDER), start + CHUNK - total))
    return left + F.least(total, start + CHUNK) - F.greatest(start, F.lit(0)) + right


def to_chunks(frames: DataFrame, lengths: DataFrame) -> DataFrame:
    """frames with chunk, start and total: each frame once for every chunk that reads it (three at most), with no join of ranges."""
    total, frame = F.col("total"), F.col("frame")
    last = (F.ceil(total / STRIDE) - 1).cast("int")
    around = F.floor(frame / STRIDE).cast("int")
    near = F.array_distinct(F.array(around - 1, around, around + 1, last))
    with_all = frames.join(lengths, "piece_id").withColumn("chunk", F.explode(near)).where((F.col("chunk") >= 0) & (F.col("chunk") <= last))
    with_all = with_all.withColumn("start", chunk_start(F.col("chunk"), total))
    return with_all.where((frame >= F.col("start")) & (frame < F.col("start") + CHUNK))


def predict(frames: DataFrame, make_model: Callable[[], Model], value: str = "mel") -> DataFrame:
    """logits (piece_id, frame, beat, downbeat) of frames (piece_id, frame, value: array).

    make_model is called in the Python worker; each (piece, chunk) group goes through the model on its own, so a long piece
    is many tasks.
    """
    lengths = frames.groupBy("piece_id").agg((F.max("frame") + 1).cast("long").alias("total"))
    kind = frames.schema["piece_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        start, total, chunk = int(pdf.start.iloc[0]), int(pdf.total.iloc[0]), int(pdf.chunk.iloc[0])
        left, right = max(0, -start), max(0, min(BORDER, start + CHUNK - total))
        x = np.pad(np.stack(pdf[value].to_numpy()), ((left, right), (0, 0)))
        beat, down = make_model()(x[None].astype(np.float32))
        frame = start + np.arange(len(x))
        keep = slice(BORDER, len(x) - BORDER)
        out = pd.DataFrame({"piece_id": pdf.piece_id.iloc[0], "frame": frame[keep], "beat": np.asarray(beat)[0][keep], "downbeat": np.asarray(down)[0][keep]})
        return out[(out.frame // STRIDE == chunk) & (out.frame < total)]

    chunks = to_chunks(frames, lengths).select("piece_id", "frame", value, "chunk", "start", "total")
    return chunks.groupBy("piece_id", "chunk").applyInPandas(run, f"piece_id {kind}, frame int, beat float, downbeat float")


def local_sum_model(radius: int) -> Callable[[], Model]:
    """A stand-in model: centred sums of each frame's first value over `radius` frames to each side, zeros beyond."""

    def make() -> Model:
        def model(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            v = np.pad(x[:, :, 0].astype(np.float64), ((0, 0), (radius, radius)))
            sums = np.apply_along_axis(lambda r: np.convolve(r, np.ones(2 * radius + 1), "valid"), 1, v)
            return sums, -sums

        return model

    return make


def pick_output(outputs: dict[str, np.ndarray], name: str) -> np.ndarray:
    """A model's output by its name, or the name with _logits."""
    for key in (name, f"{name}_logits"):
        if key in outputs:
            return outputs[key]
    raise KeyError(f"no output {name} or {name}_logits among {sorted(outputs)}")


_sessions: dict = {}  # path: session, for the life of a Python worker


def onnx_session(path: str):
    """The session of an ONNX file on one CPU thread, loaded once in each Python process."""
    if path not in _sessions:
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = 1
        _sessions[path] = ort.InferenceSession(path, options, providers=["CPUExecutionProvider"])
    return _sessions[path]


def onnx_model(path: str) -> Callable[[], Model]:
    """A model in an ONNX file: input spectrogram, outputs beat and downbeat."""

    def make() -> Model:
        session = onnx_session(path)

        def model(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found = dict(zip([o.name for o in session.get_outputs()], session.run(None, {session.get_inputs()[0].name: x}), strict=True))
            return pick_output(found, "beat"), pick_output(found, "downbeat")

        return model

    return make


def chunk_iterator(frames: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(start, padded chunk) of a whole array, for use without Spark."""
    total = len(frames)
    n = -(-total // STRIDE)
    for k in range(n):
        start = total - (CHUNK - BORDER) if k == n - 1 and total > STRIDE else k * STRIDE - BORDER
        left, right = max(0, -start), max(0, min(BORDER, start + CHUNK - total))
        yield start, np.pad(frames[max(0, start) : min(total, start + CHUNK)], ((left, right), (0, 0)))
