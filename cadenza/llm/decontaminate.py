"""Benchmark decontamination with an FM-index over every shard of the training text.

The benchmark's windows (13 words, or a whole shorter item) form the alphabet: each of their distinct words is a
symbol, every other word and every document end is symbol 0.  Each shard, some 2 MB of documents, gets

* a suffix array, by prefix doubling.  No window holds symbol 0, so each 0 counts as a terminator of its own,
  ordered by position, and ties never reach past it;
* the BWT in a wavelet matrix with ranks by 64-bit word;
* sampled suffix positions: every 8th symbol, and each symbol that follows a 0.

Backward search runs for all windows at once and drops those whose interval is empty; the rest are located by LF steps
to the next sample.  Overlapping occurrences merge into removal spans.

Nothing is shuffled: a shard lives and dies in one task.  The windows come from the benchmark, not from the corpus.  They
are written to the shared folder in files of `block_items` items each and mapped by the tasks, which go through them
file by file; so neither the driver nor a task holds more than one file of windows.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .frames import col, extend, spread
from .shared import mapped, new_folder, write

SAMPLE = 8
SHARD_BYTES = 2 << 20


class WaveletMatrix:
    """Ranks and access over integers below 2**bits."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(values), bits, []
        for b in range(bits - 1, -1, -1):
            one = (values >> b) & 1 == 1
            packed = np.packbits(np.concatenate([one, np.zeros(64 - len(one) % 64, bool)]), bitorder="little").view(np.uint64)
            ranks = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=ranks[1:])
            self.levels.append((b, packed, ranks, self.n - int(ranks[-1])))
            values = np.concatenate([values[~one], values[one]])

    @staticmethod
    def _ones(packed: np.ndarray, ranks: np.ndarray, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return ranks[w] + np.bitwise_count(packed[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i values equal c."""
        start, end = np.zeros(len(i), np.int64), i
        for b, packed, ranks, zeros in self.levels:
            one = (c >> b) & 1 == 1
            s, e = self._ones(packed, ranks, start), self._ones(packed, ranks, end)
            start, end = np.where(one, zeros + s, start - s), np.where(one, zeros + e, end - e)
        return end - start

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value at i, its occurrences before i)."""
        value, start, at = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), i
        for b, packed, ranks, zeros in self.levels:
            one = (packed[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            value |= one.astype(np.int64) << b
            s, e = self._ones(packed, ranks, start), self._ones(packed, ranks, at)
            start, at = np.where(one, zeros + s, start - s), np.where(one, zeros + e, at - e)
        return value, at - start


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffixes in order, where each 0 is a terminator that differs from all others and sorts by position."""
    n = len(text)
    k = max(1, 63 // bits)
    zero = np.flatnonzero(text == 0)
    nxt = np.append(zero, n)
    room = nxt[np.searchsorted(zero, np.arange(n))] - np.arange(n)  # symbols before the next terminator
    key, padded = np.zeros(n, np.uint64), np.concatenate([text, np.zeros(k, text.dtype)]).astype(np.uint64)
    for i in range(k):
        key = (key << np.uint64(bits)) | np.where(room > i, padded[i : i + n], np.uint64(0))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = np.zeros(n, bool)  # tied with the one before
    same[1:] = (ordered[1:] == ordered[:-1]) & (room[order[1:]] >= k)
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    rank[order] = head
    while True:
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        group, suffix = head[at], order[at]
        ahead = np.where(suffix + k < n, rank[np.minimum(suffix + k, n - 1)], -1)
        sub = np.lexsort((suffix, ahead, group))
        suffix, ahead, group = suffix[sub], ahead[sub], group[sub]
        order[at] = suffix
        still = np.zeros(len(at), bool)
        still[1:] = (group[1:] == group[:-1]) & (ahead[1:] == ahead[:-1]) & (room[suffix[1:]] >= 2 * k)
        same[at] = still
        head[at] = np.maximum.accumulate(np.where(still, 0, at))
        rank[suffix] = head[at]
        k *= 2


class FMIndex:
    """FM-index of symbols below 2**bits; patterns must not hold 0."""

    def __init__(self, text: np.ndarray, bits: int):
        self.n = len(text)
        order = suffix_array(text, bits)
        before = np.where(order > 0, text[order - 1], 0)
        self.wave = WaveletMatrix(before.astype(np.int64), bits)
        self.less = np.zeros((1 << bits) + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=1 << bits), out=self.less[1:])
        kept = (order % SAMPLE == 0) | (before == 0)
        packed = np.packbits(np.concatenate([kept, np.zeros(64 - self.n % 64, bool)]), bitorder="little").view(np.uint64)
        ranks = np.zeros(len(packed) + 1, np.int64)
        np.cumsum(np.bitwise_count(packed), out=ranks[1:])
        self.mark, self.places = (packed, ranks), order[kept].astype(np.int32)

    def search(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns that occur, with the bounds of their intervals."""
        live = np.arange(len(start))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for step in range(int(size.max(initial=0))):
            go = size[live] > step
            if not go.any():
                break
            c = symbols[start[live[go]] + size[live[go]] - 1 - step].astype(np.int64)
            lo[go], hi[go] = self.less[c] + self.wave.rank(c, lo[go]), self.less[c] + self.wave.rank(c, hi[go])
            some = hi > lo
            live, lo, hi = live[some], lo[some], hi[some]
        return live, lo, hi

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks."""
        out, left, steps = np.empty(len(i), np.int64), np.arange(len(i)), 0
        packed, ranks = self.mark
        while len(left):
            hit = (packed[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[left[hit]] = self.places[WaveletMatrix._ones(packed, ranks, i[hit])] + steps
            left, i = left[~hit], i[~hit]
            c, r = self.wave.access_rank(i)
            i = self.less[c] + r
            steps += 1
        return out


def write_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_items: int) -> tuple[str, int, DataFrame]:
    """Write the windows of the items in files; returns the folder, the number of files and the item ids."""
    folder = new_folder(benchmark.sparkSession, "windows")
    items = benchmark.select(col(id_col).cast("string").alias("i"), col(text_col).alias("t")).where("i is not null")
    files = -(-items.count() // block_items)

    def cut(table):
        k = table["k"][0].as_py()
        names, starts, sizes, owner, words, total = [], [], [], [], [], 0
        name = table["i"].to_pylist()
        for a, b, at, data in K.blocks(table["t"].combine_chunks()):
            low = K.lower(data)
            s, e, first = K.spans(K.ALNUM[low], at)
            words.append(K.span_hash(low, s, e))
            for r in range(b - a):
                m = int(first[r + 1] - first[r])
                if m:
                    w = min(window, m)
                    at_ = total + first[r] + np.arange(m - w + 1)
                    starts.append(at_)
                    sizes.append(np.full(len(at_), w))
                    owner.append(np.full(len(at_), len(names)))
                    names.append(name[a + r])
            total += len(s)
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        h = np.concatenate(words) if words else np.zeros(0, np.uint64)
        vocab, symbols = np.unique(h, return_inverse=True)
        order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        text = json.dumps([names[i] for i in order]).encode()
        write(f"{folder}/{k}", {"vocab": vocab, "symbols": (symbols + 1).astype(np.int64), "start": join(starts), "size": join(sizes), "owner": place[join(owner)], "names": np.frombuffer(text, np.uint8)})
        return pa.table({"k": pa.array([k], pa.int32())})

    items.withColumn("k", F.pmod(F.xxhash64("i"), F.lit(max(1, files))).cast("int")).groupBy("k").applyInArrow(cut, "k int").count()
    made = items.withColumn("k", F.pmod(F.xxhash64("i"), F.lit(max(1, files))).cast("int")).select("k").distinct()
    return folder, files, made


def find_windows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_items: int = 20_000) -> DataFrame:
    """docs with n_words, n_hit, items (ids as strings, sorted) and spans (merged [start, end) word and byte ranges).

    A document word is hit if an occurrence of a window covers it.  Null or empty texts have no words and no hits.
    Items without words and items whose id is null are left out; repeated items count once, whatever characters their ids hold; an empty benchmark hits
    nothing.  Columns named like the new ones are replaced.
    """
    folder, files, made = write_windows(benchmark, item_col, item_text_col, window, block_items)
    parts = sorted(r.k for r in made.collect()) if files else []  # a number for each `block_items` items

    def mark(batch):
        column = batch.column(batch.schema.get_field_index(text_col))
        words, hits, found, spans = [], [], [], []
        for a, b, at, data in K.blocks(column, SHARD_BYTES):
            low = K.lower(data)
            s, e, first = K.spans(K.ALNUM[low], at)
            h, row = K.span_hash(low, s, e), K.row_of(first)
            n = len(h)
            cover, named = np.zeros(n + 1, np.int64), [[] for _ in range(b - a)]
            for k in parts:
                x, _ = mapped(f"{folder}/{k}")
                if not len(x["vocab"]) or not n:
                    continue
                i = np.minimum(np.searchsorted(x["vocab"], h), len(x["vocab"]) - 1)
                symbol = np.where(x["vocab"][i] == h, i + 1, 0)
                text = np.zeros(n + (b - a), np.int64)  # each row's words, then a 0
                text[np.arange(n) + row] = symbol
                index = FMIndex(text, max(1, int(len(x["vocab"])).bit_length()))
                live, lo, hi = index.search(x["symbols"], x["start"], x["size"])
                if not len(live):
                    continue
                count = hi - lo
                which = np.repeat(live, count)
                ranks = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
                place = index.locate(ranks)
                doc = np.searchsorted(first[1:] + np.arange(1, b - a + 1), place, "right")
                np.add.at(cover, place - doc, 1)
                np.add.at(cover, place - doc + x["size"][which], -1)
                names = json.loads(bytes(x["names"]))
                pair = np.unique(doc * len(names) + x["owner"][which])
                for p in pair.tolist():
                    named[p // len(names)].append(names[p % len(names)])
            hit = np.cumsum(cover)[:n] > 0
            words.append(np.diff(first))
            total = np.append(0, np.cumsum(hit))
            hits.append(total[first[1:]] - total[first[:-1]])
            one, other, by_row = K.spans(hit, first)
            for r in range(b - a):
                found.append(sorted(set(named[r])))
                spans.append([{"start": int(one[j] - first[r]), "end": int(other[j] - first[r]), "byte_start": int(s[one[j]] - at[r]), "byte_end": int(e[other[j] - 1] - at[r])} for j in range(by_row[r], by_row[r + 1])])
        join = lambda x: np.concatenate(x).astype(np.int64)
        span = pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "end", "byte_start", "byte_end")]))
        return {"n_words": pa.array(join(words)), "n_hit": pa.array(join(hits)), "items": pa.array(found, pa.list_(pa.string())), "spans": pa.array(spans, span)}

    span = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "end", "byte_start", "byte_end")]))
    return extend(docs, mark, [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", span)])


def contaminated(n_words="n_words", n_hit="n_hit"):
    """At least one word in twenty is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def cut_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The texts of find_windows without their spans (null stays null); other columns stay."""
    here = f"`{text_col}`"
    pieces = F.expr(
        f"aggregate(spans, struct(binary('') AS done, 0 AS at), (a, s) -> struct(concat(a.done, substring(encode({here}, 'UTF-8'), a.at + 1, s.byte_start - a.at)) AS done, s.byte_end AS at),"
        f" a -> decode(concat(a.done, substring(encode({here}, 'UTF-8'), a.at + 1)), 'UTF-8'))"
    )
    return docs.withColumn(text_col, F.when(F.size("spans") > 0, pieces).otherwise(col(text_col)))


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "text")
    out = find_windows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
def decontamination_sql(table: str = "documents") -> str:
    """The measures of op8, with the text and the hit words' places (from 1), in DuckDB's SQL."""
    return f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
pat AS (SELECT DISTINCT item, L, array_to_string(w[i : i + L - 1], ' ') AS p
        FROM (SELECT item, w, L, unnest(range(1, len(w) - L + 2)) AS i FROM (SELECT item, w, least(13, len(w)) AS L FROM iw WHERE len(w) > 0))),
dw AS (SELECT doc_id, text, coalesce({_WORDS}, []) AS w FROM {table}),
occ AS (SELECT d.doc_id, d.i, d.L, pat.item
        FROM (SELECT doc_id, L, i, array_to_string(w[i : i + L - 1], ' ') AS p
              FROM (SELECT doc_id, w, L, unnest(range(1, len(w) - L + 2)) AS i FROM dw, (SELECT DISTINCT L FROM pat) WHERE len(w) >= L)) d
        JOIN pat ON pat.p = d.p AND pat.L = d.L),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit, list(DISTINCT k) AS hits FROM (SELECT doc_id, unnest(range(i, i + L)) AS k FROM (SELECT DISTINCT doc_id, i, L FROM occ)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, text, hits
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


OP8_SQL = f"SELECT * EXCLUDE (text, hits) FROM ({decontamination_sql()})"


def cut_sql(table: str) -> str:
    """(doc_id, text) without the spans, from a table of decontamination_sql: words and the gaps between them in turn, less hit words and the gaps between two."""
    return f"""
SELECT doc_id, CASE WHEN hits IS NULL THEN text ELSE array_to_string(list_transform(list_filter(
  list_zip(parts, range(1, len(parts) + 1)), lambda p: NOT CASE WHEN (p[2] + odd) % 2 = 0 THEN list_contains(hits, (p[2] + odd) // 2)
  ELSE list_contains(hits, (p[2] + odd - 1) // 2) AND list_contains(hits, (p[2] + odd + 1) // 2) END), lambda p: p[1]), '') END AS text
FROM (SELECT *, CASE WHEN regexp_matches(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]') THEN 1 ELSE 0 END AS odd,
  regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+|[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS parts FROM {table})
"""
