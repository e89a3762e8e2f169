"""Peaks, snapping, numbering and tempo, against literal cases and a sequential fold."""

import json
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import evaluate
from cadenza.operators.align import snap_downbeats
from cadenza.operators.meter import number_beats
from cadenza.operators.peaks import find_peaks, merge_peaks, merge_sorted
from cadenza.operators.tempo import beat_intervals, median_bpm
from cadenza.plans.analysis import analyze_logits, decode_arrays
from cadenza.sources.audio import read_golden, read_results, write_golden
from cadenza.sources.sinks import result_json


def logits(spark, series, score="beat"):
    rows = [(p, i, float(v), -1.0) for p, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "piece_id string, frame int, beat float, downbeat float")


def times(spark, series):
    return spark.createDataFrame([(p, float(t)) for p, values in series.items() for t in values], "piece_id string, time float")


def by_piece(rows, field):
    out = {}
    for r in sorted(rows, key=lambda r: (r.piece_id, r[field])):
        out.setdefault(r.piece_id, []).append(r[field])
    return out


def test_peaks(spark):
    two = [0.0] * 20
    two[3], two[15] = 2.0, 1.5
    found = find_peaks(logits(spark, {"one": [0, 0, 0.5, 1, 0.5, 0, 0], "none": [-1, -0.5, -2, -0.1], "two": two, "plateau": [0, 1, 1, 0], "nan": [0, 1, float("nan"), 0.5, 0]}), "beat")
    assert by_piece(found.collect(), "frame") == {"one": [3], "two": [3, 15], "plateau": [1, 2], "nan": [1, 2]}
    merged = by_piece(merge_peaks(found).collect(), "position")
    assert merged["plateau"] == [1.5] and merged["two"] == [3, 15]


def test_peaks_do_not_depend_on_blocks(spark):
    rng = random.Random(3)
    x = logits(spark, {"a": [rng.randint(-2, 3) for _ in range(500)], "b": [rng.randint(-2, 3) for _ in range(33)]})
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(find_peaks(x, "beat"))
    assert whole == rows(find_peaks(x, "beat", block=7)) == rows(find_peaks(x, "beat", block=4))


def test_merge(spark):
    frames = spark.createDataFrame([("a", f) for f in (10, 11, 12, 20)], "piece_id string, frame int")
    assert by_piece(merge_peaks(frames).collect(), "position") == {"a": [10.5, 12, 20]}
    rows = spark.createDataFrame([([10, 11, 12, 20],), ([10, 11, 11, 20],), ([],)], "f array<int>").select(merge_sorted(F.col("f")).alias("m")).collect()
    assert [r.m for r in rows] == [[10.5, 12, 20], [pytest.approx(32 / 3), 20], []]


def test_snap(spark):
    beats = times(spark, {"a": [1, 2, 3], "b": [1, 2, 3], "tie": [1, 2]})
    downs = times(spark, {"a": [1.1, 2.8], "b": [1.8, 2.1], "tie": [1.5], "alone": [1, 2, 2]})
    assert by_piece(snap_downbeats(beats, downs).collect(), "time") == {"a": [1, 3], "b": [2], "tie": [1], "alone": [1, 2, 2]}


NUMBERED = {
    "plain": ([0.5, 1, 1.5, 2, 2.5, 3], [0.5, 2], [1, 2, 3, 1, 2, 3]),
    "none": ([0.5, 1, 1.5], [], [2, 3, 4]),
    "late": ([0.5, 1, 1.5, 2], [1.5], [2, 3, 1, 2]),
    "pickup": ([i * 0.5 for i in range(8)], [1, 3], [3, 4, 1, 2, 3, 4, 1, 2]),
    "long": ([i * 0.5 for i in range(7)], [1.5, 2.5], [2, 3, 4, 1, 2, 1, 2]),
}


def test_numbers(spark):
    found = number_beats(times(spark, {k: v[0] for k, v in NUMBERED.items()}), times(spark, {k: v[1] for k, v in NUMBERED.items()})).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.piece_id, r.time)):
        got.setdefault(r.piece_id, []).append(r.beat)
        assert r.downbeat == (r.beat == 1)
    assert got == {k: v[2] for k, v in NUMBERED.items()}


def test_tempo(spark):
    beats = times(spark, {"even": [i * 0.5 for i in range(7)], "one": [1.0], "slow": [0, 3, 6.5]})
    found = {r.piece_id: r.bpm for r in median_bpm(beats, times(spark, {"even": [0], "one": [0], "slow": [0], "none": [0]})).collect()}
    assert found == {"even": 120, "one": None, "slow": None, "none": None}
    assert beat_intervals(beats).count() == 6


def test_decode(spark):
    beat, down = [-5.0] * 200, [-5.0] * 200
    beat[50], beat[100], beat[150], down[51] = 3.0, 2.5, 4.0, 2.0
    assert decode_arrays(beat, down, spark) == ([1, 2, 3], [1])
    with pytest.raises(ValueError, match="different length"):
        decode_arrays([1.0, 2.0], [1.0], spark)


def fold(beat, down):
    """Beats, downbeats and numbers of one piece, step by step."""
    f = np.float32

    def peaks(x):
        found = [i for i, v in enumerate(x) if v > 0 and v >= max(x[max(0, i - 3) : i + 4])]
        out, group = [], []
        for p in found:
            if group and p - sum(group) / len(group) <= 1:
                group.append(p)
            else:
                if group:
                    out.append(sum(group) / len(group))
                group = [p]
        return [f(v / 50) for v in (out + [sum(group) / len(group)] if group else out)]

    beats, downs = peaks(beat), peaks(down)
    if beats:
        downs = sorted({min(beats, key=lambda b: (abs(b - d), b)) for d in downs})
    marks = [i for i, b in enumerate(beats) if b in downs]
    start = 1
    if len(marks) >= 2 and marks[0] < marks[1] - marks[0]:
        start = marks[1] - marks[0] - marks[0]
    numbers, n = [], start
    for b in beats:
        n = 1 if b in downs else n + 1
        numbers.append(n)
    return beats, downs, numbers


def test_whole_chain_against_the_fold(spark):
    rng = random.Random(7)
    series = {f"p{k}": ([rng.randint(-2, 3) for _ in range(60)], [rng.randint(-3, 2) for _ in range(60)]) for k in range(25)}
    series["flat"] = ([-1] * 10, [-1] * 10)
    rows = [(p, i, float(b), float(d)) for p, (x, y) in series.items() for i, (b, d) in enumerate(zip(x, y))]
    found = {r.piece_id: r for r in analyze_logits(spark.createDataFrame(rows, "piece_id string, frame int, beat float, downbeat float")).collect()}
    assert set(found) == set(series)
    for p, (x, y) in series.items():
        beats, downs, numbers = fold(x, y)
        assert [b.time for b in found[p].beats] == [float(b) for b in beats]
        assert found[p].downbeats == [float(d) for d in downs]
        assert [b.beat for b in found[p].beats] == numbers
        gaps = [b - a for a, b in zip(beats, beats[1:]) if np.float32(0.1) < b - a < np.float32(3)]
        bpm = float(np.float32(60 / float(np.float32(statistics.median([float(g) for g in gaps]))))) if gaps else None
        assert found[p].bpm == bpm


def annotation(seed, n=160, beats_a_bar=4, pickup=2):
    """Beat and downbeat times of an invented piece, on frames, with some bars of three."""
    rng = random.Random(seed)
    beats, downs, t, left = [], [], 0.3, pickup
    for _ in range(n):
        if not left:
            downs.append(round(t, 6))
            left = beats_a_bar - (rng.random() < 0.1)
        beats.append(round(t, 6))
        left -= 1
        t += 0.02 * rng.choice([24, 25, 25, 25, 26])
    return beats, downs


@pytest.mark.parametrize("pickup", [0, 2, 3])
def test_annotations(spark, tmp_path, pickup):
    """Written, read again, numbered and timed, against a plain count."""
    beats, downs = annotation(pickup, pickup=pickup)
    path = str(tmp_path / "annotation.json")
    write_golden(path, [b + 1e-9 for b in beats], downs, {"fps": 50, "command": "none"})
    read = read_golden(spark, path)
    row = read.first()
    assert row.beats == [float(np.float32(b)) for b in beats] and row.downbeats == [float(np.float32(d)) for d in downs] and row.provenance["fps"] == "50"
    b, d = (read.select(F.lit("x").alias("piece_id"), F.explode(c).alias("time")) for c in ("beats", "downbeats"))
    gaps = [float(np.float32(y) - np.float32(x)) for x, y in zip(beats, beats[1:])]
    assert median_bpm(b).first().bpm == float(np.float32(60 / float(np.float32(statistics.median(gaps)))))
    first, second = (beats.index(x) for x in downs[:2])
    n, want = (second - first - first if first < second - first else 1), []
    for x in beats:
        n = 1 if x in downs else n + 1
        want.append(n)
    assert [r.beat for r in number_beats(b, d).orderBy("time").collect()] == want
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_golden(spark, str(tmp_path / "missing.json"))


def test_scores_of_annotations(spark):
    """An annotation against one that has shifted, lost and gained beats, by the window of 70 ms."""
    rng = random.Random(5)
    beats, _ = annotation(5)
    lost, shifted = set(rng.sample(range(160), 9)), set(rng.sample(range(160), 12))
    other = [b + (0.1 if i in shifted else rng.uniform(-0.05, 0.05)) for i, b in enumerate(beats) if i not in lost] + [500.0, 501.0]
    near = sum(i not in lost and i not in shifted for i in range(160))
    row = evaluate.f_measure(times(spark, {"x": beats}), times(spark, {"x": other})).first()
    p, r = near / len(other), near / 160
    assert (row.matched, row.n_ref, row.n_est) == (near, 160, len(other))
    assert row.f_measure == pytest.approx(2 * p * r / (p + r)) and row.max_matched_diff <= 0.0501
    assert evaluate.f_measure(times(spark, {"x": beats}), times(spark, {"x": beats})).first().f_measure == 1


def test_results_round_trip(spark, tmp_path):
    """A result file as the command line writes it, read again."""
    row = analyze_logits(logits(spark, {"a": [5 if i % 25 == 0 else -5 for i in range(200)]})).first()
    (tmp_path / "a.json").write_text(result_json(row))
    back = read_results(spark, str(tmp_path / "a.json")).first()
    assert back.beats == [b.time for b in row.beats] and len(back.beats) == 8 and back.downbeats == row.downbeats == [] and back.bpm == row.bpm == 120


def test_f_measure(spark):
    row = evaluate.f_measure(times(spark, {"a": [1, 2]}), times(spark, {"a": [1, 2, 5], "b": [1]}), 0.07).collect()
    found = {r.piece_id: r for r in row}
    assert found["a"].f_measure == pytest.approx(0.8) and found["a"].matched == 2
    assert found["b"].f_measure == 0 and found["b"].n_ref == 0
    near = evaluate.nearest_match(times(spark, {"a": [1, 2, 3]}), times(spark, {"a": [1.01, 2.5]}), 0.02).first()
    assert (near.matched, near.missed, near.spurious) == (1, 2, 1)


def test_beats_come_from_one_scan(spark, data):
    from cadenza.plans import queries

    plan = queries.beat_numbers(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_compare_positions(spark):
    a = spark.createDataFrame([("x", 1.0, 1), ("x", 2.0, 2), ("x", 3.0, 3)], "piece_id string, time float, beat int")
    b = spark.createDataFrame([("x", 1.01, 1), ("x", 2.5, 2)], "piece_id string, time float, beat int")
    assert sorted(r.position for r in evaluate.compare_positions(a, b).collect()) == [1, 2]


def test_batch_summary(spark):
    rows = spark.createDataFrame([(10.0, 2.0, False), (20.0, 4.0, False), (99.0, 9.0, True)], "duration_secs double, processing_time_secs double, failed boolean")
    row = evaluate.batch_summary(rows, 0.5).first()
    assert (row.total_files, row.failed_files, row.total_duration_secs, row.realtime_factor) == (3, 1, 30, 5)
    assert evaluate.batch_summary(rows.limit(0)).first().realtime_factor == 0


def test_json_shape(spark):
    from cadenza.sources.sinks import json_rows

    row = json_rows(analyze_logits(logits(spark, {"a": [-1, -1]}))).first()
    assert json.loads(row.json) == {"beats": [], "downbeats": [], "bpm": None}
