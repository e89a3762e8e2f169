"""Queries over the driver's tables, each with the same in DuckDB's SQL.

`events` stands in for recordings: a piece is a user, a frame an event in order of (ts, event_id).  The beat score is
floor(value / 20) - 1 and the downbeat score floor(value two frames back / 20) - 3.  Chunks run over all events as one piece.
Clicks are rendered at 2,205 Hz, not at MIX_RATE.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import BORDER, CHUNK, STRIDE
from ..functions.render import click_samples
from ..operators import chunking, evaluate, tempo
from ..operators.features import has_bands, mono_mix
from ..operators.peaks import find_peaks, merge_peaks, peak_times, to_seconds
from ..sources.sinks import beats_lines, json_rows
from .analysis import analyze_logits, decode_logits, number_logits

CLICK_RATE = 2205


def logits(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", "value", (F.row_number().over(by) - 1).alias("frame"), F.coalesce(F.lag("value", 2).over(by), F.lit(0.0)).alias("late"))
    return rows.select(F.col("user_id").alias("piece_id"), "frame", (F.floor(F.col("value") / 20) - 1).cast("float").alias("beat"), (F.floor(F.col("late") / 20) - 3).cast("float").alias("downbeat"))


def one_piece(spark: SparkSession, d: str) -> DataFrame:
    """frames (piece_id, frame, mel of one band): all events in order.

    Ranks come from parts cut at quantiles of the time, whose number follows the rows, and the parts' counts; so no task sorts all
    rows.  The bounds are literals: both uses of the parts see the same.  Events of one microsecond are in one part.
    """
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"), "event_id", "value")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // 1_000_000)
    bounds = rows.agg(F.percentile_approx("at", [k / parts for k in range(1, parts)] or [0.5], 10 * parts)).first()[0] or []
    cuts = [float("-inf"), *sorted(set(bounds)), float("inf")]
    placed = Bucketizer(splits=cuts, inputCol="at", outputCol="part").transform(rows)
    before = placed.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("at", "event_id")) - 1
    ranked = placed.withColumn("place", place).join(F.broadcast(before.select("part", F.coalesce("before", F.lit(0)).alias("before"))), "part")  # a row a part
    return ranked.select(F.lit(0).cast("long").alias("piece_id"), (F.col("before") + F.col("place")).cast("int").alias("frame"), F.array(F.floor("value").cast("float")).alias("mel"))


def sliding_max_peaks(spark, d):
    return find_peaks(logits(spark, d), "beat")


def peak_merge(spark, d):
    return merge_peaks(find_peaks(logits(spark, d), "beat"))


def frame_to_time(spark, d):
    return merge_peaks(find_peaks(logits(spark, d), "beat")).select("piece_id", "position", to_seconds(F.col("position")).cast("double").alias("time"))


def asof_snap(spark, d):
    return decode_logits(logits(spark, d))[1].select("piece_id", F.col("time").cast("double").alias("time"))


def beat_numbers(spark, d):
    return number_logits(logits(spark, d)).select("piece_id", F.col("time").cast("double").alias("time"), "beat", "downbeat")


def downbeat_flag(spark, d):
    return number_logits(logits(spark, d)).groupBy("piece_id").agg(F.count_if("downbeat").alias("n_downbeats"), F.count("*").alias("n_beats"))


def beat_intervals(spark, d):
    found = tempo.beat_intervals(peak_times(logits(spark, d), "beat"))
    return found.select("piece_id", F.col("time").cast("double").alias("time"), F.col("interval").cast("double").alias("interval"))


def median_bpm(spark, d):
    x = logits(spark, d)
    return tempo.median_bpm(peak_times(x, "beat"), x.select("piece_id")).select("piece_id", F.col("bpm").cast("double").alias("bpm"))


def chunk_starts(spark, d):
    total = spark.read.parquet(f"{d}/events.parquet").agg(F.count("*").alias("total")).select(F.lit(0).cast("long").alias("piece_id"), "total")
    found = chunking.chunk_starts(total).join(total, "piece_id")
    return found.select("chunk", "start", chunking.chunk_size(F.col("start"), F.col("total")).cast("int").alias("size"))


def chunk_merge(spark, d):
    out = chunking.predict(one_piece(spark, d), chunking.local_sum_model(BORDER))
    return out.select("frame", F.col("beat").cast("double").alias("beat"), F.col("downbeat").cast("double").alias("downbeat"))


def mono_mixdown(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", mono_mix(F.col("embedding"), F.lit(2)).alias("mono"))
    return rows.select("vec_id", F.size("mono").alias("n"), F.round(F.aggregate("mono", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")), 4).alias("total"))


def frame_shapes(spark, d):
    cut = F.slice("embedding", 1, F.when(F.col("vec_id") % 7 == 0, 60).otherwise(64))  # some frames lack bands
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", cut.alias("mel"))
    return rows.select("vec_id", F.size("mel").alias("bands"), has_bands(F.col("mel"), 64).alias("valid"))


def batch_totals(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg((F.count("*") / 50).alias("duration_secs"), (F.sum("value") / 1000).alias("processing_time_secs"))
    found = evaluate.batch_summary(rows.withColumn("failed", F.col("user_id") % 10 == 0))
    return found.select("total_files", "failed_files", *[F.round(F.col(c).cast("double"), 1).alias(c) for c in ("total_duration_secs", "total_processing_time_secs", "realtime_factor")])


def click_mix(spark, d):
    return click_samples(number_logits(logits(spark, d)), CLICK_RATE).select("piece_id", "pos", F.round("sample", 5).alias("sample"))


def beats_text(spark, d):
    return beats_lines(number_logits(logits(spark, d))).select("piece_id", "line")


def result_rows(spark, d):
    found = analyze_logits(logits(spark, d))
    return found.select("piece_id", F.size("beats").alias("n_beats"), F.size("downbeats").alias("n_downbeats"), F.array_join(F.transform("beats", lambda b: b.beat.cast("string")), " ").alias("counts"), F.col("bpm").cast("double").alias("bpm"))


def json_texts(spark, d):
    return json_rows(analyze_logits(logits(spark, d)))


def _two(spark, d):
    """Beats, and the same from scores one step lower as the estimate."""
    x = logits(spark, d)
    lower = x.withColumn("beat", F.col("beat") - 1)
    return peak_times(x, "beat"), peak_times(lower, "beat")


def _rounded(df):
    """Doubles to nine decimals: sums in another order differ after those."""
    return df.select(*[F.round(f.name, 9).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def match_positional(spark, d):
    number = lambda b: b.withColumn("beat", F.row_number().over(Window.partitionBy("piece_id").orderBy("time")) % 4)
    a, b = _two(spark, d)
    found = evaluate.compare_positions(number(a), number(b))
    return found.select("piece_id", "position", F.col("left_time").cast("double").alias("left_time"), F.col("right_time").cast("double").alias("right_time"))


def match_greedy(spark, d):
    return _rounded(evaluate.f_measure(*_two(spark, d)))


def match_nearest(spark, d):
    return _rounded(evaluate.nearest_match(*_two(spark, d), 0.02))


def score_difference(spark, d):
    return logits(spark, d).groupBy("piece_id").agg(evaluate.largest_difference(F.col("beat"), F.col("downbeat")).cast("double").alias("largest"))


QUERIES = {
    "sliding_max_peaks": sliding_max_peaks, "peak_merge": peak_merge, "frame_to_time": frame_to_time, "asof_snap": asof_snap, "beat_numbers": beat_numbers, "downbeat_flag": downbeat_flag,
    "beat_intervals": beat_intervals, "median_bpm": median_bpm, "chunk_starts": chunk_starts, "chunk_merge": chunk_merge, "mono_mix": mono_mixdown, "frame_shapes": frame_shapes, "batch_summary": batch_totals,
    "click_mix": click_mix, "beats_text": beats_text, "result_rows": result_rows, "json_rows": json_texts, "match_positional": match_positional, "match_greedy": match_greedy, "match_nearest": match_nearest,
    "score_difference": score_difference,
}

_LOGITS = """lg AS (SELECT user_id AS piece_id, frame, CAST(floor(value / 20) - 1 AS FLOAT) AS beat, CAST(floor(coalesce(late, 0) / 20) - 3 AS FLOAT) AS downbeat FROM
  (SELECT user_id, value, row_number() OVER w - 1 AS frame, lag(value, 2) OVER w AS late FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""


def _peaks(name: str, score: str, minus: int = 0) -> str:
    return f"""{name}_p AS (SELECT piece_id, frame FROM (SELECT piece_id, frame, {score} - {minus} AS x, max({score} - {minus}) OVER (PARTITION BY piece_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM lg) WHERE x > 0 AND x = top),
{name}_r AS (SELECT piece_id, frame, frame - row_number() OVER (PARTITION BY piece_id ORDER BY frame) AS run FROM {name}_p),
{name}_m AS (SELECT piece_id, avg(frame) AS position FROM (SELECT piece_id, run, frame, (row_number() OVER (PARTITION BY piece_id, run ORDER BY frame) - 1) // 2 AS pair FROM {name}_r) GROUP BY piece_id, run, pair),
{name} AS (SELECT piece_id, CAST(CAST(position AS DOUBLE) / 50.0 AS FLOAT) AS time FROM {name}_m)"""


_BEATS = f"{_LOGITS},\n{_peaks('b', 'beat')}"
_DECODE = f"""{_BEATS},
{_peaks('d', 'downbeat')},
near AS (SELECT d.piece_id, d.time, lo.time AS before, hi.time AS after FROM d ASOF LEFT JOIN b lo ON d.piece_id = lo.piece_id AND d.time > lo.time ASOF LEFT JOIN b hi ON d.piece_id = hi.piece_id AND d.time <= hi.time),
down AS (SELECT DISTINCT piece_id, CASE WHEN before IS NULL AND after IS NULL THEN time WHEN before IS NULL THEN after WHEN after IS NULL THEN before WHEN abs(time - before) <= abs(after - time) THEN before ELSE after END AS time FROM near)"""
_NUMBER = f"""{_DECODE},
mk AS (SELECT b.piece_id, b.time, CASE WHEN down.time IS NULL THEN 0 ELSE 1 END AS is_down FROM b LEFT JOIN down ON b.piece_id = down.piece_id AND b.time = down.time),
pl AS (SELECT *, row_number() OVER w - 1 AS rank, sum(is_down) OVER w AS measure FROM mk WINDOW w AS (PARTITION BY piece_id ORDER BY time)),
fs AS (SELECT piece_id, min(rank) FILTER (WHERE is_down = 1 AND measure = 1) AS f, min(rank) FILTER (WHERE is_down = 1 AND measure = 2) AS s FROM pl GROUP BY piece_id),
num AS (SELECT piece_id, time, CAST(row_number() OVER (PARTITION BY piece_id, measure ORDER BY time) + CASE WHEN measure = 0 THEN CASE WHEN s IS NOT NULL AND f < s - f THEN s - f - f ELSE 1 END ELSE 0 END AS INTEGER) AS beat FROM pl JOIN fs USING (piece_id))"""
_INTERVALS = "iv AS (SELECT * FROM (SELECT piece_id, time, time - lag(time) OVER (PARTITION BY piece_id ORDER BY time) AS interval FROM b) WHERE interval > 0.1::FLOAT AND interval < 3.0::FLOAT)"
_BPM = f"{_INTERVALS},\nbpm AS (SELECT piece_id, CAST(60.0::DOUBLE / CAST(median(interval) AS FLOAT) AS FLOAT) AS bpm FROM iv GROUP BY piece_id)"
_PAIR = f"{_BEATS},\n{_peaks('e', 'beat', 1)}"
_LISTS = f"""WITH RECURSIVE {_PAIR},
lists AS (SELECT piece_id, coalesce(r, []) AS r, coalesce(e, []) AS e FROM (SELECT piece_id, list(CAST(time AS DOUBLE) ORDER BY time) AS r FROM b GROUP BY piece_id) x
  FULL JOIN (SELECT piece_id, list(CAST(time AS DOUBLE) ORDER BY time) AS e FROM e GROUP BY piece_id) y USING (piece_id))"""
_N, _A, _D = 220, 22, 110  # samples of a click, its attack and its decay at CLICK_RATE

ORACLE_SQL = {
    "sliding_max_peaks": f"WITH {_BEATS} SELECT piece_id, CAST(frame AS INTEGER) AS frame FROM b_p",
    "peak_merge": f"WITH {_BEATS} SELECT piece_id, position FROM b_m",
    "frame_to_time": f"WITH {_BEATS} SELECT piece_id, position, CAST(CAST(position / 50.0 AS FLOAT) AS DOUBLE) AS time FROM b_m",
    "asof_snap": f"WITH {_DECODE} SELECT piece_id, CAST(time AS DOUBLE) AS time FROM down",
    "beat_numbers": f"WITH {_NUMBER} SELECT piece_id, CAST(time AS DOUBLE) AS time, beat, beat = 1 AS downbeat FROM num",
    "downbeat_flag": f"WITH {_NUMBER} SELECT piece_id, count(*) FILTER (WHERE beat = 1) AS n_downbeats, count(*) AS n_beats FROM num GROUP BY piece_id",
    "beat_intervals": f"WITH {_BEATS}, {_INTERVALS} SELECT piece_id, CAST(time AS DOUBLE) AS time, CAST(interval AS DOUBLE) AS interval FROM iv",
    "median_bpm": f"WITH {_BEATS}, {_BPM} SELECT piece_id, CAST(bpm AS DOUBLE) AS bpm FROM (SELECT DISTINCT piece_id FROM lg) LEFT JOIN bpm USING (piece_id)",
    "chunk_starts": f"""WITH t AS (SELECT count(*) AS total FROM events), c AS (SELECT total, unnest(range(0, CAST(ceil(total / {STRIDE}.0) AS BIGINT))) AS chunk FROM t),
s AS (SELECT total, chunk, CASE WHEN total > {STRIDE} AND chunk = ceil(total / {STRIDE}.0) - 1 THEN total - {CHUNK - BORDER} ELSE chunk * {STRIDE} - {BORDER} END AS start FROM c)
SELECT CAST(chunk AS INTEGER) AS chunk, CAST(start AS INTEGER) AS start, CAST(greatest(0, -start) + least(total, start + {CHUNK}) - greatest(start, 0) + greatest(0, least({BORDER}, start + {CHUNK} - total)) AS INTEGER) AS size FROM s""",
    "chunk_merge": f"""SELECT CAST(frame AS INTEGER) AS frame, x AS beat, -x AS downbeat FROM (SELECT row_number() OVER w - 1 AS frame, sum(CAST(floor(value) AS DOUBLE)) OVER (ORDER BY ts, event_id ROWS BETWEEN {BORDER} PRECEDING AND {BORDER} FOLLOWING) AS x FROM events WINDOW w AS (ORDER BY ts, event_id))""",
    "mono_mix": """SELECT vec_id, CAST(ceil(len(embedding) / 2.0) AS INTEGER) AS n, round(list_sum(list_transform(range(0, CAST(ceil(len(embedding) / 2.0) AS BIGINT)), lambda i: CAST(CAST((CAST(embedding[2 * i + 1] AS DOUBLE) + coalesce(CAST(embedding[2 * i + 2] AS DOUBLE), 0)) / 2 AS FLOAT) AS DOUBLE))), 4) AS total FROM embeddings""",
    "frame_shapes": "SELECT vec_id, CAST(len(mel) AS INTEGER) AS bands, len(mel) = 64 AS valid FROM (SELECT vec_id, embedding[1:CASE WHEN vec_id % 7 = 0 THEN 60 ELSE 64 END] AS mel FROM embeddings)",
    "batch_summary": """WITH f AS (SELECT user_id, count(*) / 50.0::DOUBLE AS d, sum(value) / 1000 AS p, user_id % 10 = 0 AS failed FROM events GROUP BY user_id)
SELECT count(*) AS total_files, count(*) FILTER (WHERE failed) AS failed_files, round(sum(d) FILTER (WHERE NOT failed), 1) AS total_duration_secs, round(sum(p) FILTER (WHERE NOT failed), 1) AS total_processing_time_secs,
round(sum(d) FILTER (WHERE NOT failed) / sum(p) FILTER (WHERE NOT failed), 1) AS realtime_factor FROM f""",
    "click_mix": f"""WITH {_NUMBER},
e AS (SELECT piece_id, CAST(trunc((max(time) + 0.1::FLOAT + 0.05::FLOAT) * {CLICK_RATE}::FLOAT) AS INTEGER) AS total FROM num GROUP BY piece_id),
x AS (SELECT piece_id, CAST(trunc(time * {CLICK_RATE}::FLOAT) AS INTEGER) + i AS pos, CASE WHEN i < {_A} THEN i / {_A}.0::DOUBLE WHEN i > {_N - _D} THEN ({_N} - i) / {_D}.0::DOUBLE ELSE 1.0 END
      * sin(2 * pi() * CASE WHEN beat = 1 THEN 880.0 ELSE 440.0 END * (i / {CLICK_RATE}.0::DOUBLE)) AS x FROM (SELECT *, unnest(range(0, {_N})) AS i FROM num)),
m AS (SELECT x.piece_id, pos, sum(x) AS x FROM x JOIN e ON x.piece_id = e.piece_id AND pos < total GROUP BY x.piece_id, pos),
t AS (SELECT piece_id, max(abs(x)) AS top FROM m GROUP BY piece_id)
SELECT m.piece_id, CAST(pos AS INTEGER) AS pos, round(CASE WHEN top > 1 THEN x / top ELSE x END, 5) AS sample FROM m JOIN t USING (piece_id)""",
    "beats_text": f"WITH {_NUMBER} SELECT piece_id, printf('%.3f', CAST(time AS DOUBLE)) || chr(9) || beat AS line FROM num",
    "result_rows": f"""WITH {_NUMBER}, {_BPM},
l AS (SELECT piece_id, count(*) AS n, string_agg(CAST(beat AS VARCHAR), ' ' ORDER BY time) AS counts FROM num GROUP BY piece_id), dn AS (SELECT piece_id, count(*) AS n FROM down GROUP BY piece_id)
SELECT p.piece_id, CAST(coalesce(l.n, 0) AS INTEGER) AS n_beats, CAST(coalesce(dn.n, 0) AS INTEGER) AS n_downbeats, coalesce(counts, '') AS counts, CAST(bpm AS DOUBLE) AS bpm
FROM (SELECT DISTINCT piece_id FROM lg) p LEFT JOIN l USING (piece_id) LEFT JOIN dn USING (piece_id) LEFT JOIN bpm USING (piece_id)""",
    "match_positional": f"""WITH {_PAIR}, x AS (SELECT piece_id, time, row_number() OVER (PARTITION BY piece_id ORDER BY time) - 1 AS position FROM b), y AS (SELECT piece_id, time, row_number() OVER (PARTITION BY piece_id ORDER BY time) - 1 AS position FROM e)
SELECT piece_id, CAST(position AS INTEGER) AS position, CAST(x.time AS DOUBLE) AS left_time, CAST(y.time AS DOUBLE) AS right_time FROM x FULL JOIN y USING (piece_id, position)
WHERE x.time IS NULL OR y.time IS NULL OR abs(CAST(x.time AS DOUBLE) - CAST(y.time AS DOUBLE)) > 0.02""",
    "json_rows": f"""WITH {_NUMBER}, {_BPM},
l AS (SELECT piece_id, string_agg('{{"time":' || time || ',"beat":' || beat || ',"downbeat":' || (beat = 1) || '}}', ',' ORDER BY time) AS x FROM num GROUP BY piece_id),
dn AS (SELECT piece_id, string_agg(CAST(time AS VARCHAR), ',' ORDER BY time) AS x FROM down GROUP BY piece_id)
SELECT p.piece_id, '{{"beats":[' || coalesce(l.x, '') || '],"downbeats":[' || coalesce(dn.x, '') || '],"bpm":' || coalesce(CAST(bpm AS VARCHAR), 'null') || '}}' AS json
FROM (SELECT DISTINCT piece_id FROM lg) p LEFT JOIN l USING (piece_id) LEFT JOIN dn USING (piece_id) LEFT JOIN bpm USING (piece_id)""",
    "match_greedy": f"""{_LISTS},
s AS (SELECT piece_id, r, e, 1 AS i, 1 AS j, 0 AS m, 0.0::DOUBLE AS total, 0.0::DOUBLE AS most FROM lists UNION ALL
  SELECT piece_id, r, e, CASE WHEN hit OR r[i] < e[j] THEN i + 1 ELSE i END, CASE WHEN hit OR r[i] >= e[j] THEN j + 1 ELSE j END, CASE WHEN hit THEN m + 1 ELSE m END,
    CASE WHEN hit THEN total + abs(r[i] - e[j]) ELSE total END, CASE WHEN hit THEN greatest(most, abs(r[i] - e[j])) ELSE most END
  FROM (SELECT *, abs(r[i] - e[j]) <= 0.07::DOUBLE AS hit FROM s WHERE i <= len(r) AND j <= len(e))),
o AS (SELECT *, len(r) AS n_ref, len(e) AS n_est FROM s WHERE i > len(r) OR j > len(e))
SELECT piece_id, round(CASE WHEN m > 0 THEN 2 * (m / CAST(n_est AS DOUBLE)) * (m / CAST(n_ref AS DOUBLE)) / (m / CAST(n_est AS DOUBLE) + m / CAST(n_ref AS DOUBLE)) ELSE 0 END, 9) AS f_measure, CAST(m AS BIGINT) AS matched, n_ref, n_est,
  round(most, 9) AS max_matched_diff, round(CASE WHEN m > 0 THEN total / m ELSE 0 END, 9) AS mean_matched_diff FROM o""",
    "match_nearest": f"""{_LISTS},
s AS (SELECT piece_id, r, e AS free, 1 AS i, 0 AS m, 0.0::DOUBLE AS total, 0.0::DOUBLE AS most FROM lists UNION ALL
  SELECT piece_id, r, CASE WHEN hit THEN list_concat(free[1:k - 1], free[k + 1:]) ELSE free END, i + 1, CASE WHEN hit THEN m + 1 ELSE m END,
    CASE WHEN hit THEN total + abs(free[k] - r[i]) ELSE total END, CASE WHEN hit THEN greatest(most, abs(free[k] - r[i])) ELSE most END
  FROM (SELECT *, coalesce(abs(free[k] - r[i]) <= 0.02::DOUBLE, false) AS hit FROM
    (SELECT *, list_position(list_transform(free, lambda x: abs(x - r[i])), list_min(list_transform(free, lambda x: abs(x - r[i])))) AS k FROM s WHERE i <= len(r)))),
o AS (SELECT *, len(r) AS n FROM s WHERE i > len(r))
SELECT o.piece_id, n AS ref_count, len(e) AS test_count, CAST(m AS BIGINT) AS matched, n - m AS missed, len(e) - m AS spurious,
  round(1000 * most, 9) AS max_deviation_ms, round(CASE WHEN m > 0 THEN 1000 * total / m ELSE 0 END, 9) AS mean_deviation_ms FROM o JOIN lists USING (piece_id)""",
    "score_difference": f"WITH {_LOGITS} SELECT piece_id, CAST(max(abs(beat - downbeat)) AS DOUBLE) AS largest FROM lg GROUP BY piece_id",
}
