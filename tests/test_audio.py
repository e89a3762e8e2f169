"""Chunks, features, decoding, rendering, files and the command line."""

import io
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions.render import click, npy_bytes, render_clicks, wav_bytes
from cadenza.operators import chunking
from cadenza.operators.features import check_bands, duration, log_mel, mel_frames, mono_mix, resample
from cadenza.plans import cli
from cadenza.sources import audio, sinks


@pytest.mark.parametrize("total,starts", [(0, []), (100, [-6]), (1500, [-6, 6]), (2000, [-6, 506]), (5000, [-6, 1482, 2970, 3506])])
def test_chunk_starts(spark, total, starts):
    found = chunking.chunk_starts(spark.createDataFrame([("a", total)], "piece_id string, total long")).orderBy("chunk").collect()
    assert [r.start for r in found] == starts
    assert [s for s, _ in chunking.chunk_iterator(np.zeros((total, 1)))] == starts
    sizes = [len(c) for _, c in chunking.chunk_iterator(np.zeros((total, 1)))]
    assert sizes == ([112] if total == 100 else [1500] * len(starts))


@pytest.mark.parametrize("total", [1, 100, 1488, 1489, 1495, 3100])
def test_chunked_model_equals_whole(spark, total):
    x = np.random.default_rng(total).integers(1, 9, total)
    rows = [("a", i, [float(v)]) for i, v in enumerate(x)]
    frames = spark.createDataFrame(rows, "piece_id string, frame int, mel array<float>")
    for radius, same in ((6, True), (7, False)):
        found = chunking.predict(frames, chunking.local_sum_model(radius)).orderBy("frame").collect()
        want = np.convolve(np.pad(x, radius), np.ones(2 * radius + 1), "valid")
        assert [r.frame for r in found] == list(range(total))
        if same or total == 1495:
            assert ([r.beat for r in found] == want.tolist()) == same


def test_outputs_by_name():
    assert chunking.pick_output({"beat_logits": 1}, "beat") == 1
    with pytest.raises(KeyError, match="other"):
        chunking.pick_output({"other": 1}, "beat")


def test_mono(spark):
    rows = spark.createDataFrame([([0.5, 1.5, 1.0, 3.0], 2), ([1.0, 2.0], 1), ([1.0, 3.0, 4.0], 2), ([], 2)], "s array<float>, c int")
    assert [r.m for r in rows.select(mono_mix(F.col("s"), F.col("c")).alias("m")).collect()] == [[1, 2], [1, 2], [2, 2], []]
    assert audio.mono(np.float32([1, 3, 4]), 2).tolist() == [2, 2]
    assert rows.select(duration(F.col("s"), F.lit(2)).alias("d")).first().d == 2


def test_resample_keeps_pitch():
    x = np.sin(2 * np.pi * 440 * np.arange(44100) / 44100).astype(np.float32)
    y = resample(x, 44100, 22050)
    assert len(y) == 22050 and np.abs(np.fft.rfft(y[1000:-1000] * np.hanning(20050))).argmax() * 22050 / 20050 == pytest.approx(440, abs=2)
    assert np.abs(y[2000:-2000]).max() == pytest.approx(1, abs=0.02)
    assert resample(x, 44100, 44100) is x


def test_mel(spark):
    for seconds in (1, 2, 5):
        mel = log_mel(np.zeros(22050 * seconds))
        assert 48 * seconds <= len(mel) <= 52 * seconds and mel.shape[1] == 128 and np.isfinite(mel).all()
    pcm = spark.createDataFrame([("a", 44100, [0.0] * 44100), ("short", 22050, [0.0])], "piece_id string, sample_rate int, samples array<float>")
    frames = mel_frames(pcm)
    assert {r.piece_id: r["count"] for r in frames.groupBy("piece_id").count().collect()} == {"a": 51}
    assert frames.select(check_bands(F.col("mel"))).count() == 51


def test_click():
    x = click(440, 44100)
    assert len(x) == 4410 and x[0] == 0 and np.abs(x).max() <= 1 and len(click(440, 22050)) == 2205
    track = render_clicks([1.0, 1.5], [1, 2])
    assert len(track) == int(np.float32(1.65) * 44100) and np.abs(track[:44100]).max() == 0
    mix = render_clicks([0.5], [1], 22050, np.ones(44100, np.float32))
    assert len(mix) == 44100 and mix[0] == pytest.approx(0.7)
    with pytest.raises(ValueError):
        render_clicks([], [])


def test_wav_and_npy_round_trip():
    x = np.random.default_rng(0).uniform(-1, 1, 99).astype(np.float32)
    back, rate, channels = audio.decode_wav(wav_bytes(x, 8000))
    assert (back == x).all() and (rate, channels) == (8000, 1)
    m = np.arange(6, dtype=np.float32).reshape(3, 2)
    raw = npy_bytes(m)
    assert (np.load(io.BytesIO(raw)) == m).all() and raw.index(b"\n") % 64 == 63
    with pytest.raises(ValueError):
        audio.decode_wav(b"nothing")


def test_inputs(tmp_path):
    for name in ("b.wav", "a.MP3", "c.txt", "sub/d.flac"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"")
    names = lambda found: [os.path.relpath(p, tmp_path) for p in found]
    assert names(audio.resolve_input(str(tmp_path))[0]) == ["a.MP3", "b.wav"]
    assert names(audio.resolve_input(str(tmp_path), True)[0]) == ["a.MP3", "b.wav", "sub/d.flac"]
    assert names(audio.resolve_input(f"{tmp_path}/*.wav")[0]) == ["b.wav"]
    assert audio.resolve_input(f"{tmp_path}/c.txt") == ([f"{tmp_path}/c.txt"], None)
    for bad in (f"{tmp_path}/missing", f"{tmp_path}/*.ogg"):
        with pytest.raises(FileNotFoundError):
            audio.resolve_input(bad)


def test_paths(spark):
    assert sinks.output_path("", "/x/a.wav", "click") == "/x/a.click.wav" and sinks.output_path("y", "/x/a.wav", "json") == "y" and sinks.output_path(None, "a", "json") is None
    rows = spark.createDataFrame([("/x/a.wav",), ("/x.y/b",)], "p string")
    assert [r.o for r in rows.select(sinks.output_path_column(F.col("p"), "beats").alias("o")).collect()] == ["/x/a.beats", "/x.y/b.beats"]


def test_beats_file_round_trip(spark, tmp_path):
    (tmp_path / "a.beats").write_text("0.500\t1\n1.000\t2\nbroken\n")
    assert [tuple(r) for r in audio.read_beats(spark, str(tmp_path / "a.beats")).collect()] == [(0.5, 1), (1.0, 2)]


def test_command_line(spark, tmp_path, monkeypatch):
    def loudness_model():  # a frame is a beat where it is loud
        def model(frames):
            loud = frames.mean(axis=2) - 0.5
            return loud, loud - 0.1

        return model

    rate = 22050
    x = np.zeros(rate * 4, np.float32)
    for k in range(1, 8):
        x[k * rate // 2 : k * rate // 2 + 600] = 0.9 * np.sin(np.arange(600) * 0.3)
    (tmp_path / "good.wav").write_bytes(wav_bytes(x, rate))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    (tmp_path / "long.wav").write_bytes(wav_bytes(np.tile(x, 3), rate))
    args = cli.options([str(tmp_path), "--json", "--beats", "--click", "--mix", "--mel"])
    decode, log = audio.decode_wav, str(tmp_path / "pids")

    def spy(data):
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return decode(data)

    monkeypatch.setattr(sinks, "decode_wav", spy)
    assert cli.run(spark, args, loudness_model) == 0
    pids = open(log).read().split()
    assert len(pids) == 2 and str(os.getpid()) not in pids  # one mix each, and none on the driver
    monkeypatch.undo()
    found = json.loads((tmp_path / "good.json").read_text())
    assert found["bpm"] == pytest.approx(120, abs=3) and len(found["beats"]) == 7
    assert len((tmp_path / "good.beats").read_text().splitlines()) == 7
    assert np.load(tmp_path / "good.mel.npy").shape[1] == 128
    assert len(audio.decode_wav((tmp_path / "good.mix.wav").read_bytes())[0]) >= 44100 * 4 - 2
    batch = json.loads((tmp_path / "batch_summary.json").read_text())
    assert (batch["summary"]["total_files"], batch["summary"]["failed_files"]) == (3, 1)
    one, other = batch["files"]
    assert other["duration_secs"] == pytest.approx(3 * one["duration_secs"]) and other["processing_time_secs"] > one["processing_time_secs"] > 0
    assert len(one["outputs"]) == 5 and batch["summary"]["total_processing_time_secs"] == pytest.approx(one["processing_time_secs"] + other["processing_time_secs"], rel=1e-5)
    before = (tmp_path / "good.json").stat().st_mtime_ns
    cli.run(spark, args, loudness_model)
    assert (tmp_path / "good.json").stat().st_mtime_ns == before  # there already, so left alone
    args = cli.options([str(tmp_path / "good.wav"), "--verbose", "--json", str(tmp_path / "named.json")])
    assert cli.run(spark, args, loudness_model) == 0 and json.loads((tmp_path / "named.json").read_text()) == found


def test_default_outputs():
    assert cli.flags_of(cli.options(["x"]), True)["json"] == "" and cli.flags_of(cli.options(["x"]), False)["json"] is None
    assert cli.flags_of(cli.options(["x", "--beats"]), True)["json"] is None


def test_timed_analysis_and_speedup(spark):
    from cadenza.operators.evaluate import speedup
    from cadenza.plans.analysis import analyze_timed

    def make():
        return lambda x: (x.mean(axis=2) - 1, x.mean(axis=2) - 1)

    pcm = spark.createDataFrame([("a", 22050, [0.0] * 30000)], "piece_id string, sample_rate int, samples array<float>")
    found, seconds = analyze_timed(pcm, make)
    assert found.first().beats == [] and set(seconds) == {"mel", "predict", "decode"}
    runs = spark.createDataFrame([("a", 4.0), ("a", 2.0), ("b", 3.0)], "runtime string, seconds double")
    assert {r.runtime: r.speedup for r in speedup(runs, "a").collect()} == {"a": 1, "b": 2}
