"""Quality rules: how many distinct documents of a host hold a line.

1. Each document sends one row: a hash of (host, text) and the packed hashes of its distinct normalised lines under that
   host.  Rows of equal hash collapse first, so that exact copies are one document and a hot group of copies is
   gone after the map side.
2. The survivors' lines are counted: tasks sum what they see before they send (hash, count) arrays to shards by the
   hash, so a line or a host that a third of all documents share is one entry a task.  A host's documents are counted
   under a hash of their own in the same way.
3. Each shard writes its hosts' totals and the lines that could pass a limit, sorted, to the shared folder.
4. The documents are read again and probe the memory-mapped shards; no text is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .frames import binary, col, every_shard, extend, joined, shard_count, spread, top_shard
from .line_dedup import line_keys, lines
from .shared import mapped, new_folder, write

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_HOST = np.uint64(0x51ED270B6C8F3A91)
FLUSH = 1 << 20
SHARD = 128 << 20  # bytes of texts: some million lines


def host_hash(column: pa.Array) -> np.ndarray:
    """A hash of each host; null is a host of its own."""
    out = []
    for _, _, at, data in K.blocks(column.cast(pa.string())):
        out.append(K.span_hash(data, at[:-1], at[1:]))
    h = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return np.where(np.asarray(column.is_null()), np.uint64(7), h)


def under_host(h: np.ndarray, host: np.ndarray) -> np.ndarray:
    return K.mix(h ^ K.mix(host + _HOST))


def summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(h) else c


def count_lines(docs: DataFrame, text_col: str, host_col: str, least: int) -> tuple[str, int]:
    """Write, by shard, the lines under a host that more than `least` distinct documents hold, and the hosts' totals."""
    n = shard_count(docs, text_col, SHARD)
    folder = new_folder(docs.sparkSession, "host-lines")

    def pack(batches):
        for batch in batches:
            host = host_hash(batch.column(1))
            for a, b, at, data in K.blocks(batch.column(0)):
                start, end, first, h, size = line_keys(at, data)
                row = K.row_of(first)[size > 0]
                row, h = K.unique_in_rows(row, under_host(h[size > 0], host[a:b][row]))
                cut = np.searchsorted(row, np.arange(b - a + 1))
                text = under_host(K.span_hash(data, at[:-1], at[1:]), host[a:b])
                total = under_host(np.full(b - a, _HOST), host[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(text.view(np.int64)), binary([np.append(h[cut[i] : cut[i + 1]], total[i]) for i in range(b - a)])], ["text", "lines"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            h = joined(batch.column(0), np.uint64)
            held.append(summed(h, np.ones(len(h), np.int64)))
            size += len(held[-1][0])
            if size >= FLUSH:
                yield send(held)
                held, size = [], 0
        if held:
            yield send(held)

    def send(held):
        h, c = summed(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        cut = np.searchsorted(top_shard(h, n), np.arange(n + 1))
        full = np.flatnonzero(np.diff(cut))
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), binary([h[cut[k] : cut[k + 1]] for k in full]), binary([c[cut[k] : cut[k + 1]] for k in full])], ["shard", "h", "c"])

    def keep(table):
        shard = table["shard"][0].as_py()
        h, c = summed(joined(table["h"], np.uint64), joined(table["c"], np.int64))
        often = c > least
        write(f"{folder}/{shard}", {"h": h[often], "c": c[often]})
        return pa.table({"k": pa.array([shard], pa.int32())})

    rows = docs.select(col(text_col).alias("t"), col(host_col).cast("string").alias("s")).mapInArrow(pack, "text long, lines binary")
    once = rows.groupBy("text").agg(F.min("lines").alias("lines")).select("lines")
    every_shard(once.mapInArrow(count, "shard int, h binary, c binary"), n).groupBy("shard").applyInArrow(keep, "k int").count()
    return folder, n


def lookup(folder: str, n: int, h: np.ndarray) -> np.ndarray:
    """Counts of line hashes; 0 for those that passed no limit."""
    out = np.zeros(len(h), np.int64)
    order = np.argsort(h)
    cut = np.searchsorted(top_shard(h[order], n), np.arange(n + 1))
    for k in np.flatnonzero(np.diff(cut)):
        at = order[cut[k] : cut[k + 1]]
        x, _ = mapped(f"{folder}/{k}")
        if len(x["h"]):
            i = np.minimum(np.searchsorted(x["h"], h[at]), len(x["h"]) - 1)
            out[at] = np.where(x["h"][i] == h[at], x["c"][i], 0)
    return out


def measures(at: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """The base measures of a block's texts."""
    n = len(at) - 1
    s, e, first = K.spans(K.WORD[data], at)
    row = K.row_of(first)
    h = K.span_hash(data, s, e)
    points = K.code_points(data)
    total = lambda x, by: np.bincount(by, x, n).astype(np.int64)
    symbols = np.append(0, np.cumsum(_SYMBOL[data]))
    # words inside 3-word windows that the text has twice or more
    g = K.grams(h, 3)
    inside = row[: len(g)] == row[2:] if len(g) else np.zeros(0, bool)
    g = K.mix(g ^ K.mix(row[: len(g)].astype(np.uint64)))
    places = np.flatnonzero(inside)
    order = places[np.argsort(g[places])]
    again = np.zeros(len(order), bool)
    if len(order):
        again[1:] = g[order[1:]] == g[order[:-1]]
        again[:-1] |= again[1:].copy()
    cover = np.zeros(len(h) + 3, bool)
    twice = order[again]
    for i in range(3):
        cover[twice + i] = True
    # lines with a word that equal an earlier line
    start, end, by = lines(at, data)
    of = K.row_of(by)
    some = np.searchsorted(s, end) > np.searchsorted(s, start)
    of, lh = of[some], K.span_hash(data, start[some], end[some])
    distinct, _ = K.unique_in_rows(of, lh)
    return {
        "n_words": np.diff(first).astype(np.int64), "word_chars": total(points[e] - points[s], row), "n_symbols": symbols[at[1:]] - symbols[at[:-1]],
        "n_dup_lines": np.bincount(of, minlength=n) - np.bincount(distinct, minlength=n), "n_repeat_words": total(cover[: len(h)], row),
    }


NEW = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "n_words_removed"]


def quality_rules(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", least_docs: int = 20, host_share: float = 0.01, least_left: float = 0.2, min_words: int = 50, max_repeat: float = 0.5
) -> DataFrame:
    """docs with the text stripped of lines above their host's limit, the base measures of the whole text, and kept.

    A normalised line (no white space at its ends, A-Z lower-cased) is above the limit if more than `least_docs` and
    more than `host_share` of its host's distinct texts hold it.  A document is rejected (kept false) if it fails the
    base rules (under `min_words` words, or more than `max_repeat` of them in repeated 3-word windows), or if less than
    `least_left` of its words are left without those lines.

    Null text: no words, fails the base rules, stays null.  Null host: a host of its own.  Repeated rows and exact
    copies under a host count once.  New columns (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines_removed, n_words_removed, base_failed, kept) replace columns of the same names.
    """
    folder, n = count_lines(docs, text_col, host_col, least_docs)

    def judge(batch):
        column = batch.column(batch.schema.get_field_index(text_col))
        host = host_hash(batch.column(batch.schema.get_field_index(host_col)))
        out, texts = {k: [] for k in NEW}, []
        limit = np.maximum(least_docs, host_share * lookup(folder, n, under_host(np.full(len(host), _HOST), host)))
        for a, b, at, data in K.blocks(column):
            for k, v in measures(at, data).items():
                out[k].append(v)
            start, end, first, h, size = line_keys(at, data)
            row = K.row_of(first)
            drop = np.zeros(len(h), bool)
            asked = np.flatnonzero(size > 0)
            drop[asked] = lookup(folder, n, under_host(h[asked], host[a:b][row[asked]])) > limit[a:b][row[asked]]
            word = K.spans(K.WORD[data], at)[0] if drop.any() else start
            words = np.searchsorted(word, end) - np.searchsorted(word, start)
            lost = np.bincount(row, drop, b - a).astype(np.int64)
            out["n_lines_removed"].append(lost)
            out["n_words_removed"].append(np.bincount(row, drop * words, b - a).astype(np.int64))
            whole = data.tobytes()
            texts += [whole[at[i] : at[i + 1]] if not lost[i] else b"\n".join([whole[start[k] : end[k]] for k in range(first[i], first[i + 1]) if not drop[k]]) for i in range(b - a)]
        made = {k: np.concatenate(v) for k, v in out.items()}
        failed = (made["n_words"] < min_words) | (made["n_repeat_words"] > max_repeat * made["n_words"])
        kept = ~failed & (made["n_words"] - made["n_words_removed"] >= least_left * made["n_words"])
        text = pa.array(texts, pa.binary()).cast(pa.string())
        text = pc.if_else(column.is_null(), pa.scalar(None, pa.string()), text) if column.null_count else text
        return {text_col: text, "base_failed": pa.array(failed), "kept": pa.array(kept)} | {k: pa.array(v, pa.int64()) for k, v in made.items()}

    fields = [T.StructField(text_col, T.StringType()), *(T.StructField(k, T.LongType()) for k in NEW), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    new = {f.name.lower() for f in fields[1:]}
    return extend(docs, judge, fields).select(*[col(c) for c in docs.columns if c.lower() not in new], *[f.name for f in fields[1:]])


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"), "text")
    return quality_rules(docs).drop("text", "source")


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY = f"translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKEN = r"'[^\x20\x09-\x0D]+'"
def quality_sql(table: str = "documents") -> str:
    """The measures, kept, and the text left, in DuckDB's SQL."""
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_TOKEN}) AS w FROM {table}),
l AS (SELECT doc_id, source, text, k, line, {_KEY} AS key, len(regexp_extract_all(line, {_TOKEN})) AS n FROM (SELECT doc_id, source, text, unnest(parts) AS line, unnest(range(len(parts))) AS k FROM (SELECT *, string_split(text, chr(10)) AS parts FROM d))),
dup AS (SELECT doc_id, sum(c - 1) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS c FROM l WHERE n > 0 GROUP BY doc_id, line) GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM
  (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
host AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
f AS (SELECT l.source, key FROM l JOIN host ON l.source IS NOT DISTINCT FROM host.source WHERE key <> '' GROUP BY l.source, key, host.docs
      HAVING count(DISTINCT text) > greatest(20, 0.01 * host.docs)),
gone AS (SELECT doc_id, count(*) AS n_lines_removed, sum(n) AS n_words_removed FROM l JOIN f ON l.source IS NOT DISTINCT FROM f.source AND l.key = f.key GROUP BY doc_id),
here AS (SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE f.key IS NULL), '') AS left_text FROM l LEFT JOIN f ON l.source IS NOT DISTINCT FROM f.source AND l.key = f.key GROUP BY l.doc_id),
m AS (SELECT d.doc_id, left_text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(n_words_removed, 0) AS n_words_removed
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id) JOIN here USING (doc_id))
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lines_removed AS BIGINT) AS n_lines_removed, CAST(n_words_removed AS BIGINT) AS n_words_removed,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_words_removed >= 0.2 * n_words AS kept, left_text
FROM m
"""


OP6_SQL = f"SELECT * EXCLUDE (left_text) FROM ({quality_sql()})"
