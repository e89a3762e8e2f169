"""Finding and decoding recordings, and reading annotations."""

from __future__ import annotations

import glob
import json
import os
import struct
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import AUDIO_EXTENSIONS, SAMPLE_RATE
from ..operators.features import resample


def is_audio(path: str | Column) -> bool | Column:
    """Whether a path's last extension, in any case, is one of the audio extensions."""
    if isinstance(path, Column):
        return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)).isin(*AUDIO_EXTENSIONS)
    return os.path.splitext(path)[1].lower().lstrip(".") in AUDIO_EXTENSIONS


def list_audio(folder: str, recursive: bool = False) -> list[str]:
    """Sorted audio files of a folder."""
    walk = os.walk(folder) if recursive else [next(os.walk(folder), (folder, [], []))]
    return sorted(os.path.join(d, f) for d, _, files in walk for f in files if is_audio(f))


def resolve_input(given: str, recursive: bool = False) -> tuple[list[str], str | None]:
    """(paths, folder of the batch summary, or None for a single file).

    In this order: an existing file, whatever its extension; a folder; a pattern with *, ? or [; otherwise an error.
    """
    if os.path.isfile(given):
        return [given], None
    if os.path.isdir(given):
        found, where = list_audio(given, recursive), given
    elif any(c in given for c in "*?["):
        found, where = sorted(p for p in glob.glob(given, recursive=True) if os.path.isfile(p) and is_audio(p)), os.getcwd()
    else:
        raise FileNotFoundError(f"input not found: {given}")
    if not found:
        raise FileNotFoundError(f"no audio files in {given}")
    return found, where


def scan_audio(spark: SparkSession, paths: list[str] | str, recursive: bool = False) -> DataFrame:
    """(piece_id, content) of files: piece_id is the path.  A folder or pattern is filtered by extension in the scan."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(paths)
    found = found if isinstance(paths, list) else found.where(is_audio(F.col("path")))
    return found.select(F.col("path").alias("piece_id"), "content")


def decode_wav(data: bytes) -> tuple[np.ndarray, int, int]:
    """(interleaved float samples, rate, channels) of a RIFF WAV of integers or floats."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, raw = 12, None, None
    while at + 8 <= len(data) and raw is None:
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            form = (struct.unpack("<H", body[24:26])[0] if kind == 0xFFFE and len(body) >= 26 else kind, channels, rate, bits)
        elif name == b"data":
            raw = body
        at += 8 + size + size % 2
    if form is None or raw is None:
        raise ValueError("a WAV file without format or data")
    kind, channels, rate, bits = form
    raw = raw[: len(raw) // (bits // 8) * (bits // 8)]
    if kind == 3:
        x = np.frombuffer(raw, {32: "<f4", 64: "<f8"}[bits]).astype(np.float32)
    elif bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)).astype(np.float32)
    else:
        x = np.frombuffer(raw, {16: "<i2", 32: "<i4"}[bits]).astype(np.float64)
        x = (x / float(1 << (bits - 1))).astype(np.float32)
    if not len(x):
        raise ValueError("no audio was decoded")
    return x, rate, channels


def mono(x: np.ndarray, channels: int) -> np.ndarray:
    if channels <= 1:
        return x
    return (np.pad(x.astype(np.float64), (0, -len(x) % channels)).reshape(-1, channels).sum(1) / channels).astype(np.float32)


def load_pcm(files: DataFrame, rate: int = SAMPLE_RATE, decoder: Callable[[bytes], tuple[np.ndarray, int, int]] = decode_wav) -> DataFrame:
    """pcm (piece_id, sample_rate, samples, error, seconds) of (piece_id, content): decoded, mixed to mono, resampled.

    A file that can't be decoded keeps its row, with null samples and the error.  seconds: what the file itself took.
    """
    kind = files.schema["piece_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for piece, content in zip(pdf.piece_id, pdf.content, strict=True):
                began = time.perf_counter()
                try:
                    x, source, channels = decoder(bytes(content))
                    row = (resample(mono(x, channels), source, rate), None)
                except Exception as e:  # any decoder may fail in its own way; the row says how
                    row = (None, f"{type(e).__name__}: {e}")
                yield pd.DataFrame({"piece_id": [piece], "sample_rate": [rate], "samples": [row[0]], "error": [row[1]], "seconds": [time.perf_counter() - began]})

    return files.mapInPandas(run, f"piece_id {kind}, sample_rate int, samples array<float>, error string, seconds double")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(beats, downbeats, provenance) of reference annotations in JSON; a missing file is an error."""
    schema = "beats array<float>, downbeats array<float>, provenance map<string, string>"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def read_beats(spark: SparkSession, path: str) -> DataFrame:
    """(time, beat) of a .beats file; lines without two fields are left out."""
    fields = F.split("value", "\t")
    return spark.read.text(path).where(F.size(fields) == 2).select(fields[0].cast("double").alias("time"), fields[1].cast("int").alias("beat"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(beats: times, downbeats) of result JSON files."""
    schema = "beats array<struct<time: float, beat: int, downbeat: boolean>>, downbeats array<float>, bpm float"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.transform("beats", lambda b: b.time).alias("beats"), "downbeats", "bpm")


def write_golden(path: str, beats: list[float], downbeats: list[float], provenance: dict) -> None:
    """Annotations as JSON, times to six decimals."""
    with open(path, "w") as f:
        json.dump({"beats": [round(float(t), 6) for t in beats], "downbeats": [round(float(t), 6) for t in downbeats], "provenance": provenance}, f, indent=2)
