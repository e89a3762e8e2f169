"""Audio features: mono mix, resampling, log-mel frames."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import HOP, MEL_BANDS, MEL_HIGH, MEL_LOW, N_FFT, SAMPLE_RATE


def mono_mix(samples: Column, channels: Column) -> Column:
    """Means over the channels of interleaved samples; a short last group is still divided by `channels`."""
    groups = F.sequence(F.lit(0), (F.ceil(F.size(samples) / channels) - 1).cast("int"))
    mean = lambda i: (F.aggregate(F.slice(samples, i * channels + 1, channels), F.lit(0.0).cast("double"), lambda a, x: a + x) / channels).cast("float")
    return F.when(channels <= 1, samples).when(F.size(samples) == 0, samples).otherwise(F.transform(groups, mean))


def resample(x: np.ndarray, source: int, target: int, zeros: int = 128, cutoff: float = 0.95, block: int = 1 << 15) -> np.ndarray:
    """Windowed-sinc resampling (Blackman-Harris, squared), the signal itself where the rates are equal."""
    x = np.asarray(x, np.float32)
    if source == target or not len(x):
        return x
    ratio = target / source
    scale = min(1.0, ratio) * cutoff
    out = np.empty(round(len(x) * ratio), np.float32)
    padded = np.pad(x.astype(np.float64), zeros)
    taps = np.arange(-zeros + 1, zeros + 1)
    for a in range(0, len(out), block):
        at = np.arange(a, min(a + block, len(out))) / ratio
        whole = np.floor(at).astype(np.int64)
        d = (whole[:, None] + taps) - at[:, None]
        w = np.clip((d + zeros) / (2 * zeros), 0, 1) * 2 * np.pi
        window = (0.35875 - 0.48829 * np.cos(w) + 0.14128 * np.cos(2 * w) - 0.01168 * np.cos(3 * w)) ** 2
        out[a : a + len(at)] = (padded[np.clip(whole[:, None] + taps + zeros, 0, len(padded) - 1)] * np.sinc(d * scale) * scale * window).sum(1)
    return out


def _slaney(hz):
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, hz * 3 / 200, 15 + np.log(np.maximum(hz, 1) / 1000) * 27 / np.log(6.4))


def _slaney_inverse(mel):
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


@lru_cache
def mel_filters(bands: int = MEL_BANDS, rate: int = SAMPLE_RATE) -> np.ndarray:
    """Triangles (frequency bins x bands) on the Slaney mel scale, with a peak of one."""
    edges = _slaney_inverse(np.linspace(_slaney(MEL_LOW), _slaney(MEL_HIGH), bands + 2))
    bins = np.linspace(0, rate / 2, N_FFT // 2 + 1)[:, None]
    up = (bins - edges[:-2]) / np.diff(edges)[:-1]
    down = (edges[2:] - bins) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(up, down))


def log_mel(x: np.ndarray, bands: int = MEL_BANDS, block: int = 4096) -> np.ndarray:
    """Frames x bands: log1p(1000 * mel amplitude) over Hann windows of 1024 every 441 samples, with reflected edges."""
    if len(x) < 2:
        return np.zeros((0, bands), np.float32)
    x = np.pad(np.asarray(x, np.float64), N_FFT // 2, mode="reflect" if len(x) > N_FFT // 2 else "symmetric")
    n = 1 + (len(x) - N_FFT) // HOP
    window = np.hanning(N_FFT + 1)[:-1]
    out = np.empty((n, bands), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, N_FFT)[::HOP]
    for a in range(0, n, block):
        spectrum = np.abs(np.fft.rfft(frames[a : a + block] * window)) / np.sqrt(N_FFT)
        out[a : a + block] = np.log1p(1000 * np.maximum(spectrum @ mel_filters(bands), 1e-10))
    return out


def mel_frames(pcm: DataFrame, bands: int = MEL_BANDS) -> DataFrame:
    """frames (piece_id, frame, mel) of pcm (piece_id, sample_rate, samples); samples are resampled where they must be."""
    kind = pcm.schema["piece_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for piece, rate, samples in zip(pdf.piece_id, pdf.sample_rate, pdf.samples, strict=True):
                mel = log_mel(resample(np.asarray(samples, np.float32), int(rate), SAMPLE_RATE), bands)
                for a in range(0, len(mel), 4096):
                    part = mel[a : a + 4096]
                    yield pd.DataFrame({"piece_id": [piece] * len(part), "frame": np.arange(a, a + len(part), dtype=np.int32), "mel": list(part)})

    return pcm.select("piece_id", "sample_rate", "samples").mapInPandas(run, f"piece_id {kind}, frame int, mel array<float>")


def has_bands(mel: Column, bands: int = MEL_BANDS) -> Column:
    """Whether a frame has that number of bands; a null frame has none."""
    return F.coalesce(F.size(mel) == bands, F.lit(False))


def check_bands(mel: Column, bands: int = MEL_BANDS) -> Column:
    """Null, or an error if a frame has another number of bands."""
    return F.assert_true(has_bands(mel, bands), f"a frame must have {bands} bands")


def duration(samples: Column, rate: Column) -> Column:
    """Length in seconds, as float."""
    return (F.size(samples).cast("float") / rate.cast("float")).cast("float")
