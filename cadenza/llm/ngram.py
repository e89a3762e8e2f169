"""Language-model scoring with a sharded Elias-Fano n-gram trie.

The first level is the vocabulary: word hashes in shards by hash, each word with its exact count and its rank among all words.
Below it each shard holds a trie of the n-grams dealt to it.  A node's children are a run of the next level, bounded by
monotone pointers; a child is stored relative to its context: its word's rank, added to the last value of the run before,
so that each level is one Elias-Fano sequence.  A lookup takes a node's run from the pointers and looks for the
successor inside it alone.  Hashes, counts, pointers and successors are Elias-Fano sequences; smoothed
probabilities and backoff weights of every level are 8-bit codes on a log scale.

Smoothing: absolute discounting, interpolated: p(w|ctx) = max(c(ctx w) - D, 0) / c(ctx) + D * kinds(ctx) / c(ctx) * p(w|shorter ctx),
with p(w) = (1 - u) c(w) / N for a known word, and u, the share of words seen once, for the class of all unknown words.

Dealing: an n-gram goes to the shard of its first word.  A word is hot if its count is over a quarter of a shard's even share;
while the words of a prefix are all hot, the next word counts too.  So no word, pair or longer phrase is too frequent for a
shard, and every task knows the shard from the vocabulary's counts, without a list.  A context of hot words alone has its
successors in many shards: their sums are made by one more small grouping, and a last job turns its successors' counts to codes.

Building takes two counted passes over the texts, words and then n-grams; tasks sum before they send.  Scoring reads the texts
once more against the memory-mapped shards: nothing is shuffled, broadcast or collected but a row of totals a shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .elias_fano import EliasFano
from .frames import binary, col, every_shard, extend, joined, shard_count, spread, top_shard
from .graph import stored
from .quality import summed
from .shared import mapped, new_folder, write

END = np.uint64(0xE4D0FE4D0FE4D0FF)
ORDER = 3
DISCOUNT = 0.75
FLUSH = 1 << 20
BLOCK = 4 << 20
CODES = 255
DEPTH = 14.0  # the codes cover 10**-DEPTH to 1
SHORT = 4  # children that a lookup steps through
NONE = -1  # the place of a word in an n-gram that is shorter


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 10.0**-DEPTH)) * (CODES / DEPTH)), 0, CODES).astype(np.uint8)


LEVELS = 10.0 ** (-np.arange(CODES + 1) * (DEPTH / CODES))


def tokens(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each row's words and its end, index of each row's first token)."""
    low = K.lower(data)
    s, e, first = K.spans(K.WORD[low], at)
    n = len(at) - 1
    out = np.empty(len(s) + n, np.uint64)
    ends = first[1:] + np.arange(n)
    out[np.arange(len(s)) + K.row_of(first)] = K.span_hash(low, s, e)
    out[ends] = END
    return out, np.append(0, ends + 1)


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of one of each distinct key, which of them each key is)."""
    order = np.argsort(key)
    s = key[order]
    head = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(head) - 1
    return order[head], which


def by_shard(shard: np.ndarray, n: int):
    """(shard, places) of every shard that occurs; places in order."""
    order = np.argsort(shard.astype(np.uint16) if n <= 1 << 16 else shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(n + 1)) if n <= len(shard) else None
    if cut is None:
        some, start = np.unique(shard[order], return_index=True)
        cut = np.append(start, len(order))
        return [(int(k), order[cut[i] : cut[i + 1]]) for i, k in enumerate(some)]
    return [(int(k), order[cut[k] : cut[k + 1]]) for k in np.flatnonzero(np.diff(cut))]


class Vocabulary:
    """The first level: lookups of words in all shards."""

    def __init__(self, folder: str, sizes: np.ndarray, total: int, once: int):
        self.folder, self.offset, self.n, self.total = folder, np.append(0, np.cumsum(sizes)), len(sizes), total
        self.unknown = (once + 1) / (total + once + 1)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or -1, count) of hashes."""
        one, which = groups(h)
        rank, count = np.full(len(one), NONE, np.int64), np.zeros(len(one), np.int64)
        for k, at in by_shard(top_shard(h[one], self.n).astype(np.int64), self.n):
            x, _ = mapped(f"{self.folder}/words-{k}")
            i, hit = EliasFano.of(x, "words").successor(h[one[at]])
            at, i = at[hit], i[hit]
            a, b = EliasFano.of(x, "counts").pair(i)
            rank[at], count[at] = self.offset[k] + i, (b - a).astype(np.int64)
        return rank[which], count[which]

    def hot(self, count: np.ndarray) -> np.ndarray:
        return count * (4 * self.n) > self.total

    def alone(self, count: np.ndarray) -> np.ndarray:
        """Smoothed probabilities of single words, as coded."""
        p = (1 - self.unknown) * count / max(1, self.total)
        return np.where(count > 0, LEVELS[quantise(p)], self.unknown)


def words_model(train: DataFrame, folder: str, n: int) -> Vocabulary:
    """Write the first level."""

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, at, data in K.blocks(batch.column(0), BLOCK):
                h = np.sort(tokens(at, data)[0])
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                held.append((h[first], np.diff(np.append(first, len(h)))))
                size += len(first)
                if size >= FLUSH:
                    held = [summed(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][0])
                    if size >= FLUSH // 2:
                        yield send(*held[0])
                        held, size = [], 0
        if held:
            yield send(*summed(*(np.concatenate(x) for x in zip(*held))))

    def send(h, c):
        cut = np.searchsorted(top_shard(h, n), np.arange(n + 1))
        full = np.flatnonzero(np.diff(cut))
        c = c.astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), binary([h[cut[i] : cut[i + 1]] for i in full]), binary([c[cut[i] : cut[i + 1]] for i in full])], ["shard", "k", "c"])

    def build(table):
        k = table["shard"][0].as_py()
        h, c = summed(joined(table["k"], np.uint64), joined(table["c"], np.int64))
        write(f"{folder}/words-{k}", EliasFano.build(h, 1 << 64).arrays("words") | EliasFano.build(np.append(0, np.cumsum(c)), int(c.sum()) + 1).arrays("counts"))
        return pa.table({"shard": pa.array([k], pa.int32()), "words": pa.array([len(h)], pa.int64()), "tokens": pa.array([int(c.sum())], pa.int64()), "once": pa.array([int((c == 1).sum())], pa.int64())})

    packed = every_shard(train.mapInArrow(count, "shard int, k binary, c binary"), n).repartition(n, "shard")
    rows = packed.groupBy("shard").applyInArrow(build, "shard int, words long, tokens long, once long").collect()  # a row a shard
    sizes = np.zeros(n, np.int64)
    for r in rows:
        sizes[r.shard] = r.words
    return Vocabulary(folder, sizes, sum(r.tokens for r in rows), sum(r.once for r in rows))


def route(grams: list[np.ndarray], hot: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each n-gram, whether all its words are hot)."""
    h, on = K.mix(grams[0].astype(np.uint64) + np.uint64(1)), hot[0].copy()
    for w, warm in zip(grams[1:], hot[1:]):
        there = w != NONE
        step = on & there
        h = np.where(step, K.mix(h ^ K.mix(w.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))), h)
        on &= warm | ~there
    return top_shard(h, n).astype(np.int64), on


def context_key(words: list[np.ndarray]) -> np.ndarray:
    """A 64-bit key of a context."""
    h = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        h = K.mix(h ^ K.mix(w.astype(np.uint64) + np.uint64(0xD1342543DE82EF95)))
    return h


def split_grams(rank: np.ndarray, hot: np.ndarray, first: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(words, whether they are hot) of the records of a block's n-grams, NONE and True where an n-gram is shorter.

    Each place gives the n-gram of full order that starts there, or the shorter one that the row's end ends; and each prefix
    of two words or more whose words are all hot, for such a prefix's longer n-grams are spread over shards.
    """
    n = len(rank)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # tokens from here to the row's end
    pad = np.full(order, NONE, np.int64)
    words = [np.where(left > m, np.append(rank, pad)[m : m + n], NONE) for m in range(order)]
    warm = [np.where(left > m, np.append(hot, np.ones(order, bool))[m : m + n], True) for m in range(order)]
    at = [np.flatnonzero(left >= 2)]
    cut = [np.full(len(at[0]), order)]
    on = warm[0].copy()
    for m in range(2, order):
        on &= warm[m - 1]
        at.append(np.flatnonzero(on & (left > m)))
        cut.append(np.full(len(at[-1]), m))
    at, cut = np.concatenate(at), np.concatenate(cut)
    return [np.where(m < cut, w[at], NONE) for m, w in enumerate(words)], [np.where(m < cut, w[at], True) for m, w in enumerate(warm)]


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of integers, the first non-decreasing, as compressed byte planes."""
    size = len(columns[0])
    planes = [np.array([size], np.int64).view(np.uint8)]
    for i, c in enumerate(columns):
        c = np.diff(c, prepend=0) if i == 0 else c + 1
        planes.append(np.ascontiguousarray(c.astype(np.int64).view(np.uint8).reshape(size, 8).T).ravel())
    return pa.Codec("zstd", compression_level=1).compress(np.concatenate(planes), asbytes=True)


def unpack(cells: pa.ChunkedArray, sizes: pa.ChunkedArray, columns: int) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(columns)]
    codec = pa.Codec("zstd")
    for cell, size in zip(cells, sizes):
        if not cell.is_valid:
            continue
        raw = np.frombuffer(codec.decompress(cell.as_buffer(), 8 + 8 * columns * size.as_py()), np.uint8)
        planes = raw[8:].reshape(columns, 8, size.as_py())
        for i in range(columns):
            c = np.ascontiguousarray(planes[i].T).view(np.int64).ravel()
            out[i].append(np.cumsum(c) if i == 0 else c - 1)
    return [np.concatenate(x) for x in out]


def distinct_grams(grams: list[np.ndarray], count: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams in order, with their summed counts."""
    first, local = np.unique(grams[0], return_inverse=True)
    places = [local, *(g + 1 for g in grams[1:])]
    bits = [int(p.max(initial=0)).bit_length() for p in places]
    if sum(bits) <= 64:  # one sort of packed keys
        key = np.zeros(len(count), np.uint64)
        for p, b in zip(places, bits):
            key = (key << np.uint64(b)) | p.astype(np.uint64)
        key, count = summed(key, count)
        out = []
        for b in reversed(bits):
            out.append((key & np.uint64((1 << b) - 1)).astype(np.int64) - 1)
            key = key >> np.uint64(b)
        return [first[out[-1] + 1], *reversed(out[:-1])], count
    one, which = groups(context_key(grams))
    count = np.bincount(which, count, len(one)).astype(np.int64)
    order = np.lexsort([g[one] for g in reversed(grams)])
    return [g[one[order]] for g in grams], count[order]


def build_trie(grams: list[np.ndarray], count: np.ndarray, hot_word) -> tuple[dict[str, np.ndarray], list[tuple]]:
    """The arrays of a shard's trie from its distinct n-grams in order, and (key, kinds, count) of its split contexts.

    hot_word tells which words are hot.  Successors of split contexts keep their counts, until the contexts' sums are known.
    """
    order, size = len(grams), len(count)
    new = np.zeros(size, bool)
    new[:1] = True
    out, contexts = {}, []
    one, which = groups(grams[0].astype(np.uint64))
    hot_first = hot_word(grams[0][one])[which] if size else np.zeros(0, bool)
    node_of, split, sums, total = None, None, None, None  # of the level above: each row's node, and by node
    for m in range(1, order + 1):
        w = grams[m - 1]
        new = new | np.concatenate([[True], w[1:] != w[:-1]])[:size]
        head = np.flatnonzero(new & (w != NONE))
        here = np.full(size, -1, np.int64)
        inside = np.flatnonzero(w != NONE)
        here[inside] = (np.cumsum(new & (w != NONE)) - 1)[inside]
        nodes = len(head)
        own = np.bincount(here[inside], count[inside], nodes).astype(np.int64)  # all of a node's records
        if m == 1:
            out |= EliasFano.build(w[head].astype(np.uint64), int(w[head].max(initial=0)) + 2).arrays("root")
            all_hot, home = hot_first[head], np.ones(nodes, bool)
        else:
            ranks, back = groups(w[head].astype(np.uint64))
            all_hot = split[node_of[head]] & (hot_word(w[head][ranks])[back] if nodes else np.zeros(0, bool))
            # a node of hot words is at home where its own record is; its longer n-grams may be elsewhere
            short = np.flatnonzero((w != NONE) & (grams[m] == NONE)) if m < order else head
            alone = np.bincount(here[short], count[short], nodes).astype(np.int64)
            home = ~all_hot | (alone > 0)
            own = np.where(all_hot, alone, own)
            parent = node_of[head]
            pointers = np.searchsorted(parent, np.arange(len(split) + 1))
            last = np.zeros(len(split), np.int64)
            some = np.flatnonzero(np.diff(pointers))
            last[some] = w[head][pointers[some + 1] - 1]
            base = np.cumsum(last) - last
            out |= EliasFano.build((base[parent] + w[head]).astype(np.uint64), int(last.sum()) + 1).arrays(f"next{m}")
            out |= EliasFano.build(pointers.astype(np.uint64), nodes + 1).arrays(f"pointers{m}")
            kinds = np.bincount(parent[home], minlength=len(split))
            sums = np.bincount(parent[home], own[home], len(split)).astype(np.int64)
            out[f"codes{m}"] = quantise(np.maximum(own - DISCOUNT, 0) / np.maximum(sums[parent], 1))
            out[f"backoff{m - 1}"] = quantise(DISCOUNT * kinds / np.maximum(sums, 1))
            late = np.flatnonzero(split[parent] & home)
            out |= {f"late{m}": late, f"late_count{m}": own[late], f"late_key{m}": context_key([g[head[late]] for g in grams[: m - 1]])}
            at = np.flatnonzero(split & (kinds > 0))
            contexts.append((context_key([g[above[at]] for g in grams[: m - 1]]), kinds[at], sums[at]))
        node_of, split, above = here, all_hot, head
    return out, contexts


def grams_model(train: DataFrame, vocabulary: Vocabulary, folder: str, order: int) -> None:
    """Write the tries of all shards."""
    n = vocabulary.n
    names = [f"w{m}" for m in range(order)]

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, at, data in K.blocks(batch.column(0), BLOCK):
                h, first = tokens(at, data)
                rank, c = vocabulary.find(h)
                grams, hot = split_grams(rank, vocabulary.hot(c), first, order)
                one, which = groups(context_key(grams))
                c = np.bincount(which, minlength=len(one))
                grams, hot = [g[one] for g in grams], [x[one] for x in hot]
                held.append((route(grams, hot, n)[0], c, *grams))
                size += len(one)
                if size >= FLUSH:
                    yield send(held)
                    held, size = [], 0
        if size:
            yield send(held)

    def send(held):
        shard, c, *grams = (np.concatenate(x) for x in zip(*held))
        order_ = np.lexsort([grams[0], shard])
        shard, c, grams = shard[order_], c[order_], [g[order_] for g in grams]
        full, start = np.unique(shard, return_index=True)
        cut = np.append(start, len(shard))
        cells = [pack([g[cut[i] : cut[i + 1]] for g in grams] + [c[cut[i] : cut[i + 1]]]) for i in range(len(full))]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.diff(cut), pa.int64()), pa.array(cells, pa.binary())], ["shard", "size", "cell"])

    def hot_word(ranks):
        """Whether words are hot, from their ranks."""
        out = np.zeros(len(ranks), bool)
        for k, at in by_shard(np.searchsorted(vocabulary.offset, ranks, "right") - 1, n):
            a, b = EliasFano.of(mapped(f"{vocabulary.folder}/words-{k}")[0], "counts").pair(ranks[at] - vocabulary.offset[k])
            out[at] = vocabulary.hot((b - a).astype(np.int64))
        return out

    def build(table):
        k = table["shard"][0].as_py()
        *grams, c = unpack(table["cell"], table["size"], order + 1)
        arrays, contexts = build_trie(*distinct_grams(grams, c), hot_word)
        write(f"{folder}/grams-{k}", arrays)
        key, kinds, sums = (np.concatenate([x[i] for x in contexts]) for i in range(3))
        return pa.table({"key": pa.array(key.view(np.int64)), "kinds": pa.array(kinds, pa.int64()), "sums": pa.array(sums, pa.int64())})

    packed = every_shard(train.mapInArrow(count, "shard int, size long, cell binary"), n).repartition(n, "shard")
    split = stored(packed.groupBy("shard").applyInArrow(build, "key long, kinds long, sums long"), folder, "split")

    def deal(batches):
        for batch in batches:
            h = np.asarray(batch.column(0)).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(top_shard(h, n).astype(np.int32)), *batch.columns], ["shard", "key", "kinds", "sums"])

    def keep(table):
        k = table["shard"][0].as_py()
        table = table.filter(table["key"].is_valid())
        key = np.asarray(table["key"].combine_chunks()).view(np.uint64)
        order_ = np.argsort(key)
        kinds, sums = (np.asarray(table[c].combine_chunks()).astype(np.int64)[order_] for c in ("kinds", "sums"))
        write(f"{folder}/sums-{k}", {"key": key[order_], "sums": sums, "backoff": quantise(DISCOUNT * kinds / np.maximum(sums, 1))})
        return pa.table({"shard": pa.array([k], pa.int32())})

    summed_ = split.groupBy("key").agg(F.sum("kinds").alias("kinds"), F.sum("sums").alias("sums"))
    every_shard(summed_.mapInArrow(deal, "shard int, key long, kinds long, sums long"), n).repartition(n, "shard").groupBy("shard").applyInArrow(keep, "shard int").count()

    def finish(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                x, out = mapped(f"{folder}/grams-{k}")[0], {}
                for m in range(2, order + 1):
                    _, total = split_sums(folder, n, x[f"late_key{m}"])
                    out |= {f"late{m}": x[f"late{m}"], f"codes{m}": quantise(np.maximum(x[f"late_count{m}"] - DISCOUNT, 0) / np.maximum(total, 1))}
                write(f"{folder}/late-{k}", out)
            yield batch

    train.sparkSession.range(0, n, 1, max(1, min(n, n // 8))).mapInArrow(finish, "id long").count()


def split_sums(folder: str, n: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(backoff weight, count) of split contexts; 1 and 0 of others."""
    back, total = np.ones(len(key)), np.zeros(len(key), np.int64)
    for k, at in by_shard(top_shard(key, n).astype(np.int64), n):
        x, _ = mapped(f"{folder}/sums-{k}")
        if len(x["key"]):
            i = np.minimum(np.searchsorted(x["key"], key[at]), len(x["key"]) - 1)
            hit = x["key"][i] == key[at]
            back[at[hit]], total[at[hit]] = LEVELS[x["backoff"][i[hit]]], x["sums"][i[hit]]
    return back, total


def step_down(x: dict[str, np.ndarray], m: int, node: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The node at level m of a word below nodes of level m - 1; -1 where there is none (or no node)."""
    out = np.full(len(node), -1, np.int64)
    at = np.flatnonzero(node >= 0)
    nxt = EliasFano.of(x, f"next{m}")
    if not len(at) or not nxt.n:
        return out
    first, last = (v.astype(np.int64) for v in EliasFano.of(x, f"pointers{m}").pair(node[at]))
    before = nxt.place(np.maximum(first - 1, 0))
    base = np.where(first > 0, nxt.value(before, np.maximum(first - 1, 0)), np.uint64(0))  # what the run's values are relative to
    target = base + word[at].astype(np.uint64)
    short = np.flatnonzero(last - first <= SHORT)
    out[at[short]] = nxt.among(target[short], first[short], (last - first)[short], np.where(first > 0, before, -1)[short], SHORT)
    top = nxt.get(np.array([nxt.n - 1]))[0]
    long = np.flatnonzero((last - first > SHORT) & (target <= top))
    i, hit = nxt.successor(target[long], first[long], last[long])
    out[at[long[hit]]] = i[hit]
    return out


def root_node(x: dict[str, np.ndarray], word: np.ndarray) -> np.ndarray:
    root = EliasFano.of(x, "root")
    if not root.n:
        return np.full(len(word), -1, np.int64)
    top = root.get(np.array([root.n - 1]))[0]
    inside = np.flatnonzero(word.astype(np.uint64) <= top)
    out = np.full(len(word), -1, np.int64)
    i, hit = root.successor(word[inside].astype(np.uint64))
    out[inside[hit]] = i[hit]
    return out


class Model:
    """Lookups in the tries of all shards."""

    def __init__(self, folder: str, vocabulary: Vocabulary, order: int):
        self.folder, self.vocabulary, self.order = folder, vocabulary, order

    def probabilities(self, rank: np.ndarray, count: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The model's probability of each token, given those before it in its row."""
        n = self.vocabulary.n
        hot = self.vocabulary.hot(count) & (rank >= 0)
        p = self.vocabulary.alone(count)
        # level 1: contexts of one word
        at = np.flatnonzero(rank >= 0)  # last tokens of the contexts in hand
        one, which = groups(rank[at].astype(np.uint64))
        grams, warm = [rank[at[one]]], [hot[at[one]]]
        shard, split = route(grams, warm, n)
        node = np.full(len(one), -1, np.int64)
        for k, here in by_shard(shard, n):
            here = here[~split[here]]
            node[here] = root_node(mapped(f"{self.folder}/grams-{k}")[0], grams[0][here])
        for m in range(2, self.order + 1):
            # contexts of m - 1 words (grams, shard, node, split by distinct one; `which` by place): their backoff weights
            back = np.ones(len(one))
            for k, here in by_shard(shard, n):
                here = here[(node[here] >= 0) & ~split[here]]
                back[here] = LEVELS[mapped(f"{self.folder}/grams-{k}")[0][f"backoff{m - 1}"][node[here]]]
            here = np.flatnonzero(split)
            if len(here):
                back[here] = split_sums(self.folder, n, context_key([g[here] for g in grams]))[0]
            # the tokens after them
            go = np.flatnonzero((at + 1 < len(row)) & (row[np.minimum(at + 1, len(row) - 1)] == row[at]))
            at, of = at[go] + 1, which[go]
            p[at] *= back[of]
            go = np.flatnonzero((rank[at] >= 0) & ((node[of] >= 0) | split[of]))
            at, of = at[go], of[go]
            if m < self.order:
                one, which = groups(K.mix(of.astype(np.uint64) + np.uint64(1)) ^ K.mix(~rank[at].astype(np.uint64)))
            else:  # the longest are mostly distinct, and no contexts
                one = which = np.arange(len(at))
            of = of[one]
            grams, warm = [g[of] for g in grams] + [rank[at[one]]], [x[of] for x in warm] + [hot[at[one]]]
            from_split, node_above, shard_above = split[of], node[of], shard[of]
            shard, split = route(grams, warm, n)
            node, found = np.full(len(one), -1, np.int64), np.zeros(len(one))
            parents = np.where(from_split, -1, node_above)
            order_ = np.argsort((shard.astype(np.uint64) << np.uint64(40)) + (parents + 1).astype(np.uint64))  # by shard, then parent
            shards, start = np.unique(shard[order_], return_index=True)
            for k, here in zip(shards.tolist(), np.split(order_, start[1:])):
                x, _ = mapped(f"{self.folder}/grams-{k}")
                parent = parents[here]
                far = np.flatnonzero(from_split[here])  # below a split context: the whole path is in this shard
                if len(far):
                    walk = root_node(x, grams[0][here[far]])
                    for j in range(2, m):
                        walk = step_down(x, j, walk, grams[j - 1][here[far]])
                    parent[far] = walk
                node[here] = step_down(x, m, parent, grams[m - 1][here])
                near = here[(node[here] >= 0) & ~from_split[here]]
                found[near] = LEVELS[x[f"codes{m}"][node[near]]]
                far = here[(node[here] >= 0) & from_split[here]]
                if len(far):
                    late, _ = mapped(f"{self.folder}/late-{k}")
                    if len(late[f"late{m}"]):
                        i = np.minimum(np.searchsorted(late[f"late{m}"], node[far]), len(late[f"late{m}"]) - 1)
                        hit = late[f"late{m}"][i] == node[far]
                        found[far[hit]] = LEVELS[late[f"codes{m}"][i[hit]]]
            p[at] += found[which]
        return np.minimum(p, 1.0)


def score_texts(docs: DataFrame, train: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score, learned from the texts of train.

    base_score sums log10((c + 1) / (N + V + 1)) over the tokens, score the log10 probabilities of a model of `order` (2 or more).
    Null texts count as empty: one token, the end.  With nothing to learn from, every token is the unknown class and both
    scores are 0.  Repeated rows count as often as they occur.  Columns of the new names are replaced.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    texts = train.select(F.coalesce(col(text_col), F.lit("")).alias("t"))
    n = shard_count(train, text_col)
    folder = new_folder(docs.sparkSession, "ngram")
    vocabulary = words_model(texts, folder, n)
    total, v = vocabulary.total, int(vocabulary.offset[-1])
    if total:
        grams_model(texts, vocabulary, folder, order)
    model = Model(folder, vocabulary, order)

    def score(batch):
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
        for a, b, at, data in K.blocks(batch.column(batch.schema.get_field_index(text_col)), BLOCK):
            h, first = tokens(at, data)
            row = K.row_of(first)
            rank, c = vocabulary.find(h)
            p = model.probabilities(rank, c, row) if total else np.ones(len(h))
            out["n_tokens"].append(np.diff(first))
            out["n_known"].append(np.bincount(row, c > 0, b - a).astype(np.int64))
            out["base_score"].append(np.bincount(row, np.log10((c + 1) / (total + v + 1)), b - a))
            out["score"].append(np.bincount(row, np.log10(p), b - a))
        made = {k: np.concatenate(x) for k, x in out.items()}
        return {k: pa.array(x) for k, x in made.items()} | {"train_tokens": pa.array(np.full(batch.num_rows, total, np.int64))}

    kinds = {"n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType()}
    return extend(docs, score, [T.StructField(k, t) for k, t in kinds.items()])


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    from .toxicity import held_out

    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "text")
    fold = held_out("doc_id", 7, 2)
    scored = score_texts(docs, docs.where(~fold))
    return scored.select("doc_id", fold.alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def _coded(p: str) -> str:
    return f"pow(10.0::DOUBLE, -least({CODES}, greatest(0, round(-log10(greatest({p}, 1e-{DEPTH:.0f}::DOUBLE)) * ({CODES} / {DEPTH}::DOUBLE)))) * ({DEPTH}::DOUBLE / {CODES}))"


_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC = f"""xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda h, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: {_BIT}, xor(h, x)), 4294967295::BIGINT), 4294967295)"""
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: The model of order 3 over plain counts; the end of a text is a space, which no word can be.
OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append(coalesce({_WORDS}, []), ' ') AS ws FROM documents),
t AS (SELECT doc_id, held_out, w, lag(w) OVER o AS a, lag(w, 2) OVER o AS b FROM (SELECT doc_id, held_out, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
tr AS (SELECT w, a, b FROM t WHERE NOT held_out),
u1 AS (SELECT w, count(*) AS c FROM tr GROUP BY w),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v, (count(*) FILTER (WHERE c = 1) + 1) / CAST(sum(c) + count(*) FILTER (WHERE c = 1) + 1 AS DOUBLE) AS u FROM u1),
u2 AS (SELECT a, w, count(*) AS c FROM tr WHERE a IS NOT NULL GROUP BY a, w),
s2 AS (SELECT a, CAST(sum(c) AS DOUBLE) AS s, count(*) AS k FROM u2 GROUP BY a),
u3 AS (SELECT b, a, w, count(*) AS c FROM tr WHERE b IS NOT NULL GROUP BY b, a, w),
s3 AS (SELECT b, a, CAST(sum(c) AS DOUBLE) AS s, count(*) AS k FROM u3 GROUP BY b, a),
p AS (SELECT t.doc_id, t.held_out, coalesce(u1.c, 0) AS c, n.n, n.v,
        CASE WHEN u1.c IS NULL THEN n.u ELSE {_coded("(1 - n.u) * u1.c / n.n")} END AS p1,
        CASE WHEN u2.c IS NULL THEN 0 ELSE {_coded(f"(u2.c - {DISCOUNT}::DOUBLE) / s2.s")} END AS d2, CASE WHEN s2.s IS NULL THEN 1 ELSE {_coded(f"{DISCOUNT}::DOUBLE * s2.k / s2.s")} END AS b2,
        CASE WHEN u3.c IS NULL THEN 0 ELSE {_coded(f"(u3.c - {DISCOUNT}::DOUBLE) / s3.s")} END AS d3, CASE WHEN s3.s IS NULL THEN 1 ELSE {_coded(f"{DISCOUNT}::DOUBLE * s3.k / s3.s")} END AS b3
      FROM t CROSS JOIN n LEFT JOIN u1 ON t.w = u1.w LEFT JOIN s2 ON t.a = s2.a LEFT JOIN u2 ON t.a = u2.a AND t.w = u2.w
      LEFT JOIN s3 ON t.b = s3.b AND t.a = s3.a LEFT JOIN u3 ON t.b = u3.b AND t.a = u3.a AND t.w = u3.w)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, any_value(n) AS train_tokens,
       round(sum(log10((c + 1) / CAST(n + v + 1 AS DOUBLE))), 6) AS base_score, round(sum(log10(least(1.0, d3 + b3 * (d2 + b2 * p1)))), 6) AS score
FROM p GROUP BY doc_id, held_out
"""
