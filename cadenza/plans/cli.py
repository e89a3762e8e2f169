"""Command line: analyse one recording, a folder or a pattern."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.constants import SAMPLE_RATE
from ..operators.chunking import onnx_model, onnx_session
from ..operators.evaluate import batch_summary
from ..sources.audio import load_pcm, resolve_input, scan_audio
from ..sources.sinks import KINDS, local_path, result_json, write_all, write_summary
from .analysis import analyze, analyze_timed


def options(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="cadenza", description=__doc__)
    p.add_argument("input", help="a file, a folder, or a pattern")
    p.add_argument("--model", default="models/beat.onnx", help="ONNX model: spectrogram to beat and downbeat")
    for kind in KINDS:
        p.add_argument(f"--{kind}", nargs="?", const="", default=None, help="write this output; without a value, beside the input")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--verbose", action="store_true")
    return p.parse_args(argv)


def flags_of(args: argparse.Namespace, batch: bool) -> dict[str, str | None]:
    """The outputs asked for; a batch that asks for none writes JSON beside its inputs."""
    flags = {k: getattr(args, k) for k in KINDS}
    if batch and all(v is None for v in flags.values()):
        flags["json"] = ""
    return flags


def run(spark: SparkSession, args: argparse.Namespace, make_model=None) -> int:
    """Analyse and write; files that fail are listed and do not stop the others.

    Files are decoded, analysed, rendered and written by tasks; a status row of each reaches the driver.  A file's seconds are what
    it took to decode and to write, and its share by length of the analysis, whose stages take the chunks of all files together.
    """
    paths, folder = resolve_input(args.input, args.recursive)
    loading = 0.0
    if make_model is None:
        if not os.path.exists(args.model):
            raise FileNotFoundError(f"model not found: {args.model}")
        began = time.perf_counter()
        onnx_session(args.model)
        loading, make_model = time.perf_counter() - began, onnx_model(args.model)
    flags = flags_of(args, folder is not None)
    files = scan_audio(spark, paths)
    pcm = load_pcm(files).persist()
    heard = pcm.select("piece_id", "error", "seconds", (F.size("samples") / SAMPLE_RATE).alias("length")).collect()
    errors = {local_path(r.piece_id): r.error for r in heard if r.error is not None}
    good, began = pcm.where("error is null"), time.perf_counter()
    if args.verbose:
        found, stages = analyze_timed(good, make_model)
        print(", ".join(f"{k} {s:.3f} s" for k, s in stages.items()), file=sys.stderr)
        for r in found.select("piece_id", F.size("beats").alias("b"), F.size("downbeats").alias("d"), "bpm").toLocalIterator():
            print(f"{local_path(r.piece_id)}: {r.b} beats, {r.d} downbeats, {r.bpm} BPM", file=sys.stderr)
    else:
        found = analyze(good, make_model).persist()
        found.count()
    analysis, length = time.perf_counter() - began, sum(r.length for r in heard if r.error is None)
    written = {}
    if folder is None and all(v is None for v in flags.values()):
        for row in found.collect():  # one file
            print(result_json(row))
    else:
        for r in write_all(found, pcm, files, flags, args.overwrite).collect():
            if r.error is None:
                written[r.piece_id] = r.outputs, r.seconds
            else:
                errors[local_path(r.piece_id)] = r.error
    for path, error in errors.items():
        print(f"Failed {path}: {error}", file=sys.stderr)
    if folder is not None:
        entries = []
        for r in sorted((r for r in heard if r.piece_id in written), key=lambda r: r.piece_id):
            outputs, seconds = written[r.piece_id]
            entries.append({"input": local_path(r.piece_id), "duration_secs": r.length, "processing_time_secs": r.seconds + analysis * r.length / length + seconds, "outputs": outputs})
        rows = [(e["duration_secs"], e["processing_time_secs"], False) for e in entries] + [(0.0, 0.0, True)] * len(errors)
        total = batch_summary(spark.createDataFrame(rows, "duration_secs double, processing_time_secs double, failed boolean"), loading).first().asDict()
        write_summary(os.path.join(folder, "batch_summary.json"), entries, total)
    found.unpersist()
    pcm.unpersist()
    return 1 if errors and len(errors) == len(heard) else 0


def main(argv: list[str] | None = None) -> int:
    args = options(argv)
    return run(SparkSession.builder.appName("cadenza").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
