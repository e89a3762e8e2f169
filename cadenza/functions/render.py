"""Clicks and mixes as sample arrays, and the bytes of WAV and NPY files."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .constants import BEAT_PITCH, CLICK_ATTACK, CLICK_DECAY, CLICK_GAIN, CLICK_LENGTH, DOWNBEAT_PITCH, MIX_RATE, ORIGINAL_GAIN

f32 = np.float32


def click(pitch: float, rate: int) -> np.ndarray:
    """A sine of 0.1 s with a linear attack of 0.01 s and decay of 0.05 s."""
    n, attack, decay = (int(f32(x) * f32(rate)) for x in (CLICK_LENGTH, CLICK_ATTACK, CLICK_DECAY))
    i = np.arange(n)
    shape = np.where(i < attack, i / max(1, attack), np.where(i > n - decay, (n - i) / max(1, decay), 1.0))
    return (shape * np.sin(2 * np.pi * pitch * (i / rate))).astype(np.float32)


def peak_normalise(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(initial=0)
    return x / f32(top) if top > 1 else x


def render_clicks(times: np.ndarray, counts: np.ndarray, rate: int = MIX_RATE, original: np.ndarray | None = None) -> np.ndarray:
    """A click at each beat, alone or over the original; to the last beat and 0.15 s, or the original's end if that is later."""
    times = np.asarray(times, np.float32)
    if not len(times):
        raise ValueError("no beats to render")
    end = times.max() + f32(CLICK_LENGTH) + f32(CLICK_DECAY)
    if original is not None:
        end = max(end, f32(len(original)) / f32(rate))
    out = np.zeros(int(f32(end) * f32(rate)), np.float32)
    gain = f32(1)
    if original is not None:
        gain, n = f32(CLICK_GAIN), min(len(out), len(original))
        out[:n] = np.asarray(original[:n], np.float32) * f32(ORIGINAL_GAIN)
    sounds = {True: click(DOWNBEAT_PITCH, rate) * gain, False: click(BEAT_PITCH, rate) * gain}
    for t, c in zip(times, counts):
        at = int(t * f32(rate))
        sound = sounds[int(c) == 1][: max(0, len(out) - at)]
        out[at : at + len(sound)] += sound
    return peak_normalise(out)


def click_samples(beats: DataFrame, rate: int) -> DataFrame:
    """(piece_id, pos, sample) of the click track of beats (piece_id, time, beat), in DataFrame operations.

    Positions without sound are left out, the peak is not above one, and sounds beyond the track's end are cut.
    """
    n, attack, decay = (int(f32(x) * f32(rate)) for x in (CLICK_LENGTH, CLICK_ATTACK, CLICK_DECAY))
    end = beats.groupBy("piece_id").agg(((F.max("time") + F.lit(CLICK_LENGTH).cast("float") + F.lit(CLICK_DECAY).cast("float")) * F.lit(rate).cast("float")).cast("int").alias("total"))
    i = F.col("i")
    shape = F.when(i < attack, i / attack).when(i > n - decay, (n - i) / decay).otherwise(1.0)
    pitch = F.when(F.col("beat") == 1, F.lit(DOWNBEAT_PITCH)).otherwise(F.lit(BEAT_PITCH))
    sound = beats.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        "piece_id", ((F.col("time") * F.lit(rate).cast("float")).cast("int") + i).alias("pos"), (shape * F.sin(F.lit(2 * np.pi) * pitch * (i / F.lit(float(rate))))).alias("x")
    )
    mixed = sound.groupBy("piece_id", "pos").agg(F.sum("x").alias("x")).join(end, "piece_id").where(F.col("pos") < F.col("total"))
    top = mixed.groupBy("piece_id").agg(F.max(F.abs("x")).alias("top"))
    return mixed.join(top, "piece_id").select("piece_id", "pos", F.when(F.col("top") > 1, F.col("x") / F.col("top")).otherwise(F.col("x")).alias("sample"))


def wav_bytes(x: np.ndarray, rate: int) -> bytes:
    """A mono WAV of 32-bit floats."""
    data = np.asarray(x, "<f4").tobytes()
    head = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 3, 1, rate, rate * 4, 4, 32) + b"fact" + struct.pack("<II", 4, len(x)) + b"data" + struct.pack("<I", len(data))
    return b"RIFF" + struct.pack("<I", len(head) + len(data)) + head + data


def npy_bytes(x: np.ndarray) -> bytes:
    """NumPy's format 1.0: little-endian floats in C order, the header padded to a multiple of 64."""
    head = f"{{'descr': '<f4', 'fortran_order': False, 'shape': {tuple(int(n) for n in x.shape)}, }}"
    head += " " * (-(len(head) + 11) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head.encode() + np.ascontiguousarray(x, "<f4").tobytes()
