"""Results as JSON, beat lists, spectrograms and audio: as rows and as files."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import MIX_RATE
from ..functions.render import npy_bytes, render_clicks, wav_bytes
from ..operators.features import log_mel, resample
from .audio import decode_wav, mono

KINDS = ("json", "beats", "click", "mix", "mel")
_EXTENSION = {"json": "json", "beats": "beats", "click": "click.wav", "mix": "mix.wav", "mel": "mel.npy"}


def beats_lines(beats: DataFrame) -> DataFrame:
    """(piece_id, time, line): time with three decimals, a tab, the beat number."""
    return beats.select("piece_id", "time", F.format_string("%.3f\t%d", "time", "beat").alias("line"))


def results(numbered: DataFrame, tempo: DataFrame, downbeats: DataFrame | None = None) -> DataFrame:
    """(piece_id, beats, downbeats, bpm), a row for each piece of tempo.  downbeats: those to list, by default the beats numbered as such."""
    down = downbeats if downbeats is not None else numbered.where("downbeat").select("piece_id", "time")
    lists = numbered.groupBy("piece_id").agg(F.array_sort(F.collect_list(F.struct("time", "beat", "downbeat"))).alias("beats"))
    downs = down.groupBy("piece_id").agg(F.array_sort(F.collect_list("time")).alias("downbeats"))
    out = tempo.join(lists, "piece_id", "left").join(downs, "piece_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select("piece_id", empty("beats"), empty("downbeats"), "bpm")


def json_rows(found: DataFrame, pretty: bool = False) -> DataFrame:
    """(piece_id, json) of results; a null bpm is written."""
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    return found.select("piece_id", F.to_json(F.struct("beats", "downbeats", "bpm"), options).alias("json"))


def output_path(given: str | None, source: str, kind: str) -> str | None:
    """None without a flag; the source with its extension replaced for an empty flag; else the flag itself."""
    if given is None:
        return None
    return given or f"{os.path.splitext(source)[0]}.{_EXTENSION[kind]}"


def output_path_column(source: Column, kind: str) -> Column:
    return F.concat(F.regexp_replace(source, r"(?<=[^/])\.[^./]*$", ""), F.lit(f".{_EXTENSION[kind]}"))


def write_if_needed(path: str, overwrite: bool, make: Callable[[], bytes]) -> bool:
    """Write unless the file is there already and may not be overwritten; make is only called to write."""
    if os.path.exists(path) and not overwrite:
        print(f"Skipped {path} (it exists)")
        return False
    data, temp = make(), f"{path}.{os.getpid()}.part"
    with open(temp, "wb") as f:
        f.write(data)
    os.replace(temp, path)  # a task that is lost leaves no half file
    return True


def result_json(row) -> str:
    beats = [{"time": b.time, "beat": b.beat, "downbeat": b.downbeat} for b in row.beats]
    return json.dumps({"beats": beats, "downbeats": list(row.downbeats), "bpm": row.bpm}, indent=2)


def write_outputs(row, flags: dict[str, str | None], overwrite: bool = False, original: Callable[[], np.ndarray] | None = None, mel: Callable[[], np.ndarray] | None = None, rate: int = 44100) -> list[str]:
    """Write the kinds that flags ask for, in a fixed order, for one row of results; the paths written."""
    times, counts = [b.time for b in row.beats], [b.beat for b in row.beats]
    makers = {
        "json": lambda: result_json(row).encode(),
        "beats": lambda: "".join(f"{t:.3f}\t{c}\n" for t, c in zip(times, counts, strict=True)).encode(),
        "click": lambda: wav_bytes(render_clicks(times, counts), 44100),
        "mix": lambda: wav_bytes(render_clicks(times, counts, rate, original()), rate),
        "mel": lambda: npy_bytes(mel()),
    }
    out = []
    for kind in KINDS:
        path = output_path(flags.get(kind), row.piece_id, kind)
        if path and write_if_needed(path, overwrite, makers[kind]):
            out.append(path)
    return out


def local_path(piece: str) -> str:
    """The path of a file of the scan, without its scheme."""
    path = piece.removeprefix("file:")
    return path[2:] if path.startswith("//") else path


def write_all(found: DataFrame, pcm: DataFrame, files: DataFrame, flags: dict[str, str | None], overwrite: bool = False) -> DataFrame:
    """(piece_id, outputs: paths written, error, seconds) of results: each piece's files are rendered and written where its row is.

    pcm, files: what load_pcm and scan_audio gave.  Samples move only for spectrograms and file contents only for mixes.  The
    inputs' folders must be ones that the executors share.  A piece that can't be written keeps its row, with the error.
    """
    rows = found.select("piece_id", F.col("beats.time").alias("times"), F.col("beats.beat").alias("counts"), "downbeats", "bpm")
    kind = rows.schema["piece_id"].dataType.simpleString()
    if flags.get("mel") is not None:
        rows = rows.join(pcm.select("piece_id", "samples"), "piece_id")
    if flags.get("mix") is not None:
        rows = rows.join(files.select("piece_id", "content"), "piece_id")

    def original(content: bytes) -> np.ndarray:
        x, rate, channels = decode_wav(bytes(content))
        return resample(mono(x, channels), rate, MIX_RATE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                began, outputs, error = time.perf_counter(), [], None
                beats = [SimpleNamespace(time=float(t), beat=int(c), downbeat=int(c) == 1) for t, c in zip(r.times, r.counts, strict=True)]
                row = SimpleNamespace(piece_id=local_path(r.piece_id), beats=beats, downbeats=[float(t) for t in r.downbeats], bpm=None if pd.isna(r.bpm) else float(r.bpm))
                try:
                    outputs = write_outputs(row, flags, overwrite, lambda r=r: original(r.content), lambda r=r: log_mel(np.asarray(r.samples, np.float32)), MIX_RATE)
                except (OSError, ValueError) as e:
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"piece_id": [r.piece_id], "outputs": [outputs], "error": [error], "seconds": [time.perf_counter() - began]})

    return rows.mapInPandas(run, f"piece_id {kind}, outputs array<string>, error string, seconds double")


def write_summary(path: str, files: list[dict], summary: dict) -> None:
    """The batch summary, always written anew."""
    with open(path, "w") as f:
        json.dump({"files": files, "summary": summary}, f, indent=2)
