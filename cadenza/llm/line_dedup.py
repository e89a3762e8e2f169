"""Line dedup: a sharded minimal perfect hash over the corpus' distinct lines.

Pass 1 hashes each long enough line key and sends packed (hash, document) arrays to shards by the hash.
Each shard counts the distinct documents of every key, up to min_docs, and stores a minimal perfect hash with three
arrays: a fingerprint, that count and, for keys in enough documents, the largest document id.
Pass 2 reads the documents again and probes the memory-mapped arrays; no line is joined and no text is moved.

Shards are by key hash and their number follows the input's bytes.  Before it sends, a task keeps of each key the
min_docs smallest documents and the largest, so a line that a third of the documents holds is min_docs + 1 entries a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .frames import binary, col, extend, ids, joined, shard_count, spread, top_shard
from .shared import mapped, new_folder, write

GAMMA = 2.0
FLUSH = 1 << 20
SHARD = 128 << 20  # bytes of texts: some million lines
LEVELS = 40


def build_mph(keys: np.ndarray) -> tuple[dict[str, np.ndarray], list[int]]:
    """A minimal perfect hash of distinct uint64 keys: bit levels, and ranks by 64-bit word."""
    words, sizes, left, level = [], [], keys, 0
    while len(left) and level < LEVELS:
        m = -(-int(GAMMA * len(left) + 64) // 64) * 64
        at = _slot(left, level, m)
        order = np.sort(at)
        alone = np.ones(len(order), bool)
        alone[1:] &= order[1:] != order[:-1]
        alone[:-1] &= order[1:] != order[:-1]
        bits = np.zeros(m, bool)
        bits[order[alone]] = True
        words.append(np.packbits(bits, bitorder="little").view(np.uint64))
        sizes.append(m)
        left = left[~bits[at]]
        level += 1
    bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
    ranks = np.zeros(len(bits) + 1, np.uint32)
    np.cumsum(np.bitwise_count(bits), out=ranks[1:])
    return {"bits": bits, "ranks": ranks, "rest": np.sort(left)}, sizes


def _slot(keys: np.ndarray, level: int, m: int) -> np.ndarray:
    h = K.mix(keys + np.uint64((level + 1) * 0xD1342543DE82EF95 & ((1 << 64) - 1)))
    return ((h >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64) if m < 1 << 32 else (h % np.uint64(m)).astype(np.int64)


def probe_mph(mph: dict[str, np.ndarray], sizes: list[int], keys: np.ndarray) -> np.ndarray:
    """The index of each key; keys that were not indexed get any index, or -1."""
    out = np.full(len(keys), -1, np.int64)
    left, base = np.arange(len(keys)), 0
    for level, m in enumerate(sizes):
        if not len(left):
            break
        at = base + _slot(keys[left], level, m)
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        w = mph["bits"][word]
        hit = (w >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(w[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
        out[left[hit]] = mph["ranks"][word[hit]] + below
        left, base = left[~hit], base + m
    if len(left) and len(mph["rest"]):
        i = np.minimum(np.searchsorted(mph["rest"], keys[left]), len(mph["rest"]) - 1)
        found = mph["rest"][i] == keys[left]
        out[left[found]] = int(mph["ranks"][-1]) + i[found]
    return out


def lines(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of a block: start, end (without the newline), and the index of each row's first line."""
    nl = np.flatnonzero(data == 10)
    start = np.concatenate([at[:-1], nl + 1])
    end = np.concatenate([nl, at[1:]])
    row = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, nl, "right") - 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    first = np.searchsorted(row, np.arange(len(at)))
    order = np.lexsort((end, np.concatenate([np.searchsorted(at, nl, "right") - 1, np.arange(len(at) - 1)])))
    return start, end[order], first


def line_keys(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, first line of each row, key hash, key code points) of a block's lines."""
    start, end, first = lines(at, data)
    solid = np.flatnonzero(K.WORD[data])
    i, j = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = j > i
    s, e = start.copy(), start.copy()
    s[some], e[some] = solid[i[some]], solid[j[some] - 1] + 1
    points = K.code_points(data)
    return start, end, first, K.span_hash(K.lower(data), s, e), points[e] - points[s]


def condensed(held: list[tuple[np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) pairs, sorted and distinct; of each hash the `most` smallest documents and the largest.

    That is enough to tell whether `most` documents hold it, and which is the largest, however often it is repeated.
    """
    h, d = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
    keep = (np.arange(len(h)) - first < most) | np.append(head[1:], True)
    return h[keep], d[keep]


def build_index(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> tuple[str, int]:
    """Write the shards; returns their folder and number."""
    spark = docs.sparkSession
    n = shard_count(docs, text_col, SHARD)
    folder = new_folder(spark, "lines")

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            doc = ids(batch.column(0))
            for a, b, at, data in K.blocks(batch.column(1)):
                _, _, first, h, points = line_keys(at, data)
                row, h = K.unique_in_rows(K.row_of(first)[points >= min_chars], h[points >= min_chars])
                held.append((h, doc[a:b][row]))
                size += len(h)
                if size >= FLUSH:
                    held = [condensed(held, min_docs)]
                    size = len(held[0][0])
                    if size >= FLUSH // 2:
                        yield send(*held[0])
                        held, size = [], 0
        if held:
            yield send(*condensed(held, min_docs))

    def send(h, d):
        cut = np.searchsorted(top_shard(h, n), np.arange(n + 1))
        full = np.flatnonzero(np.diff(cut))
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), binary([h[cut[k] : cut[k + 1]] for k in full]), binary([d[cut[k] : cut[k + 1]] for k in full])], ["shard", "h", "d"])

    def build(table):
        shard = table["shard"][0].as_py()
        h, d = condensed([(joined(table["h"], np.uint64), joined(table["d"], np.int64))], min_docs)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.minimum(np.diff(np.append(first, len(h))), min_docs)
        keys, most = h[first], d[np.append(first[1:], len(h)) - 1]
        mph, sizes = build_mph(keys)
        at = probe_mph(mph, sizes, keys)
        prints, counts, keeper = np.zeros(len(keys), np.uint16), np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.int64)
        prints[at], counts[at], keeper[at] = (keys & np.uint64(0xFFFF)).astype(np.uint16), count, most
        often = counts >= min_docs
        bits = np.packbits(np.concatenate([often, np.zeros(-len(often) % 64, bool)]), bitorder="little").view(np.uint64)
        ranks = np.zeros(len(bits) + 1, np.uint32)
        np.cumsum(np.bitwise_count(bits), out=ranks[1:])
        write(f"{folder}/{shard}", mph | {"prints": prints, "counts": counts, "often": bits, "often_ranks": ranks, "keeper": keeper[often]}, {"sizes": sizes})
        return pa.table({"keys": pa.array([len(keys)], pa.int64())})

    docs.select(col(id_col).alias("i"), col(text_col).alias("t")).mapInArrow(pack, "shard int, h binary, d binary").groupBy("shard").applyInArrow(build, "keys long").agg(F.sum("keys")).collect()
    return folder, n


def lookup(folder: str, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in enough documents?, largest document id) of each line hash."""
    often, keeper = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    order = np.argsort(h)
    cut = np.searchsorted(top_shard(h[order], n), np.arange(n + 1))
    for k in np.flatnonzero(np.diff(cut)):
        at = order[cut[k] : cut[k + 1]]
        x, meta = mapped(f"{folder}/{k}")  # every shard is there: the keys asked for are those that built them
        i = probe_mph(x, meta["sizes"], h[at])
        known = i >= 0
        known[known] = x["prints"][i[known]] == (h[at][known] & np.uint64(0xFFFF)).astype(np.uint16)
        i, at = i[known], at[known]
        w, bit = x["often"][i >> 6], (i & 63).astype(np.uint64)
        hit = (w >> bit) & np.uint64(1) == 1
        often[at[hit]] = True
        keeper[at[hit]] = x["keeper"][x["often_ranks"][i[hit] >> 6] + np.bitwise_count(w[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))]
    return often, keeper


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with the text stripped of repeated lines, plus n_lines and n_dropped.

    A line's key is the line without white space at its ends, A-Z lower-cased.  A key of at least `min_chars` code
    points in at least `min_docs` documents loses all its lines except those of the largest id that holds it
    (`min_docs` up to 255).

    Null text: one empty line, and the text stays null.  Empty text: one empty line.  Null ids count together as one
    document, the smallest.  Repeated ids are one document and keep or lose lines together.  A text that loses every
    line becomes empty.  Columns named n_lines or n_dropped are replaced; all others pass through.
    """
    if not 1 <= min_docs <= 255:
        raise ValueError("min_docs must be from 1 to 255")
    folder, n = build_index(docs, id_col, text_col, min_chars, min_docs)

    def strip(batch):
        doc, column = ids(batch.column(batch.schema.get_field_index(id_col))), batch.column(batch.schema.get_field_index(text_col))
        texts, total, gone = [], [], []
        for a, b, at, data in K.blocks(column):
            start, end, first, h, size = line_keys(at, data)
            row = K.row_of(first)
            drop = np.zeros(len(h), bool)
            asked = np.flatnonzero(size >= min_chars)
            often, keeper = lookup(folder, n, h[asked])
            drop[asked] = often & (doc[a:b][row[asked]] != keeper)
            lost = np.add.reduceat(drop.astype(np.int64), first[:-1])
            total.append(np.diff(first))
            gone.append(lost)
            whole = data.tobytes()
            texts += [whole[at[i] : at[i + 1]] if not lost[i] else b"\n".join([whole[start[k] : end[k]] for k in range(first[i], first[i + 1]) if not drop[k]]) for i in range(b - a)]
        null = column.is_null()
        out = pa.array(texts, pa.binary()).cast(pa.string())
        if column.null_count:
            import pyarrow.compute as pc

            out = pc.if_else(null, pa.scalar(None, pa.string()), out)
        return {text_col: out, "n_lines": pa.array(np.concatenate(total), pa.int64()), "n_dropped": pa.array(np.concatenate(gone), pa.int64())}

    fields = [T.StructField(text_col, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    return extend(docs, strip, fields).select(*[col(c) for c in dict.fromkeys([*docs.columns, "n_lines", "n_dropped"]) if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
def line_dedup_sql(table: str = "documents") -> str:
    """(doc_id, n_lines, n_dropped, text) in DuckDB's SQL."""
    return f"""
WITH l AS (
  SELECT doc_id, k, line, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS k
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM {table}))),
f AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL AND l.doc_id <> f.keeper) AS n_dropped,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.k) FILTER (WHERE f.key IS NULL OR l.doc_id = f.keeper), '') AS text
FROM l LEFT JOIN f USING (key) GROUP BY l.doc_id
"""


OP10_SQL = f"SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM ({line_dedup_sql()})"
