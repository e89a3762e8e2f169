"""Toxicity by weak supervision.

1. A bounded sample of labelled documents (`max_toxic` + `max_clean`, by a hash of the id) gives up its distinct words
   and word beginnings (4, 5, 6 and 8 bytes: inflected insults share a stem), as hashes.
2. Voters: lexicons of words and of beginnings, mined by their lift and split so that voters differ; a seed lexicon;
   densities of hits; and patterns of style (shouting, runs of marks).
3. A generative label model over all voters, fitted by EM: each class has its voters' mean votes (their accuracies),
   both share the voters' covariance (their correlations), so that voters that repeat each other count once.
   The labels enter as one more, noisy voter.
4. A logistic regression on the hashed features is trained on the posterior labels; its weights, at most
   `max_features`, score every whole text in one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .frames import binary, col, extend, spread

STEMS = (4, 5, 6, 8)
SEEDS = "idiot moron stupid loser trash scum pathetic worthless disgusting clown dumb fool jerk ugly filthy vermin imbecile cretin".split()


def features(at: np.ndarray, data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of every word and of its beginnings; beginnings hash apart from words."""
    low = K.lower(data)
    s, e, first = K.spans(K.ALNUM[low], at)
    row = K.row_of(first)
    out = [(row, K.span_hash(low, s, e))]
    for n in STEMS:
        long = np.flatnonzero(e - s > n)
        out.append((row[long], K.mix(K.span_hash(low, s[long], s[long] + n) + np.uint64(n))))
    return out


def distinct(found: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The size of each row: its words and their shortest beginnings."""
    return np.bincount(found[0][0], minlength=n) + np.bincount(found[1][0], minlength=n)


def style_votes(at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Pattern voters of each row: shouting, and runs of two exclamation or question marks."""
    n = len(at) - 1
    total = lambda mask: np.diff(np.append(0, np.cumsum(mask))[at])
    upper, letters = total((data >= 0x41) & (data <= 0x5A)), total(((data >= 0x41) & (data <= 0x5A)) | ((data >= 0x61) & (data <= 0x7A)))
    loud = (data == 0x21) | (data == 0x3F)
    twice = np.append(loud[1:] & loud[:-1], False) if len(data) else np.zeros(0, bool)
    return np.stack([upper > 0.3 * np.maximum(letters, 10), total(twice) > 0], 1).reshape(n, 2)


def in_sorted(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of h that are in the table, their indexes in it)."""
    if not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = np.minimum(np.searchsorted(table, h), len(table) - 1)
    hit = np.flatnonzero(table[i] == h)
    return hit, i[hit]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class LabelModel:
    """Classes with their own mean votes and a common covariance, fitted by EM from noisy labels."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray, noise: float = 0.03, rounds: int = 12):
        v, told = votes.astype(float), np.where(labels == 1, 1.0, -1.0) * np.log((1 - noise) / noise)
        q = sigmoid(told)
        for _ in range(rounds):
            n1, n0 = q.sum() + 1, (1 - q).sum() + 1
            self.mean1, self.mean0 = (q @ v + 0.5) / n1, ((1 - q) @ v + 0.02) / n0
            d1, d0 = v - self.mean1, v - self.mean0
            self.covariance = ((d1 * q[:, None]).T @ d1 + (d0 * (1 - q)[:, None]).T @ d0) / len(v) + 0.02 * np.eye(v.shape[1])
            self.weights = np.linalg.solve(self.covariance, self.mean1 - self.mean0)
            self.bias = float(np.log(n1 / n0) - (self.mean1 + self.mean0) / 2 @ self.weights)
            q = sigmoid(v @ self.weights + self.bias + told)
        self.posterior = q

    @property
    def correlations(self) -> np.ndarray:
        d = np.sqrt(np.diag(self.covariance))
        return self.covariance / np.outer(d, d)


def one_of_copies(rows: list[np.ndarray], alike: float = 0.5) -> np.ndarray:
    """The sampled documents without near copies of earlier ones, which would make chance words look like evidence."""
    n = len(rows)
    keep, some = np.ones(n, bool), np.flatnonzero([len(r) > 0 for r in rows])
    h, first = np.concatenate([rows[i] for i in some]), np.append(0, np.cumsum([len(rows[i]) for i in some]))[:-1]
    for k in range(16):
        key = np.zeros(len(some), np.uint64)
        for j in range(3):
            key = K.mix(key ^ np.minimum.reduceat(K.mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (3 * k + j + 1) & ((1 << 64) - 1))), first))
        order = np.argsort(key, kind="stable")
        head = None
        for at in order.tolist():
            i = int(some[at])
            if head is None or key[at] != key[head]:
                head = at
            elif keep[i]:
                a, b = rows[int(some[head])], rows[i]
                z = np.sort(np.concatenate([a, b]))
                common = int((z[1:] == z[:-1]).sum())
                keep[i] = common < alike * (len(z) - common)
    return np.flatnonzero(keep)


def train(rows: list[np.ndarray], styles: np.ndarray, sizes: np.ndarray, labels: np.ndarray, max_features: int, penalty: float = 2e-5) -> dict:
    """Mine voters, fit the label model, and train the classifier on its posterior labels."""
    one = one_of_copies(rows)
    rows, styles, sizes, labels = [rows[i] for i in one], styles[one], sizes[one], labels[one]
    n = len(rows)
    h, row = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    keys, of = np.unique(h, return_inverse=True)
    bad, good = np.bincount(of, labels[row] == 1, len(keys)), np.bincount(of, labels[row] == 0, len(keys))
    n1, n0 = max(1, (labels == 1).sum()), max(1, (labels == 0).sum())
    lift = (bad / n1) / ((good + 0.5) / n0)
    chance = bad * np.log(n / n1) - good * 2  # how far from chance, in nats
    mined = np.flatnonzero((bad >= 3) & (lift >= 10) & (chance >= 9))
    # split by hash into four lexicons; a seed lexicon, densities and styles beside them
    part = np.full(len(keys), -1)
    part[mined] = (keys[mined] >> np.uint64(7)).astype(np.int64) % 4
    votes = np.zeros((n, 9))
    for k in range(4):
        votes[row[part[of] == k], k] = 1
    hits = np.bincount(row[part[of] >= 0], minlength=n)
    votes[:, 4], votes[:, 5] = hits >= 2, hits >= 4
    seed = np.sort(_hashes(SEEDS))
    votes[np.bincount(row[in_sorted(seed, h)[0]], minlength=n) > 0, 6] = 1
    votes[:, 7:] = styles
    model = LabelModel(votes, labels)
    q = model.posterior
    # features: the mined ones; common words would add up over a long text and say nothing
    picked = np.sort(mined[np.argsort(-bad[mined], kind="stable")[:max_features]])
    place = np.full(len(keys), -1)
    place[picked] = np.arange(len(picked))
    used = np.flatnonzero(place[of] >= 0)
    x, r = place[of[used]], row[used]
    # the last two weights are the bias and the size of the text (a long text meets more words by chance)
    m, size = len(picked), np.log1p(sizes)
    w = np.zeros(m + 2)
    w[m] = np.log((q.sum() + 1) / ((1 - q).sum() + 1))
    wide = np.bincount(r, minlength=n) + 1 + size
    step = 4 / np.append(np.bincount(x, wide[r], m) / n, [wide.mean(), (wide * size).mean()])
    last = w
    for k in range(800):  # Nesterov's method, each weight at the pace that its feature's frequency allows
        u = w + k / (k + 3) * (w - last)
        g = (sigmoid(np.bincount(r, u[x], n) + u[m] + u[m + 1] * size) - q) / n
        slope = np.append(np.bincount(x, g[r], m), [g.sum(), g @ size])
        last, w = w, u - step * (slope + np.append(penalty * u[:m], [0, 0]))
    return {"keys": keys[picked], "weights": w[:m], "bias": w[m], "size": w[m + 1], "model": model, "mined": len(mined)}


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = K.spans(K.ALNUM[data], np.array([0, len(data)]))
    return K.span_hash(data, s, e)


def sample_labels(labels: DataFrame, id_col: str, label_col: str, max_toxic: int, max_clean: int) -> DataFrame:
    """At most about max_toxic + max_clean labelled ids, by a hash of the id: the ids of the lowest hashes of each class."""
    one = labels.where(F.col(label_col).isin(0, 1) & col(id_col).isNotNull()).groupBy(col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    n = {r.y: r.n for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    parts = [one.where((F.col("y") == y) & (u < min(1.0, 2 * most / max(1, n.get(y, 0))))).orderBy(u, "id").limit(most) for y, most in ((1, max_toxic), (0, max_clean))]
    return parts[0].unionByName(parts[1])


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, max_toxic: int = 2500, max_clean: int = 4500, max_features: int = 8000
) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold).

    Null or empty texts score as a text without any feature.  Without labels of both classes every score is 0.  Labels
    that are null or not 0 or 1 are left out; an id labelled twice is toxic if any label says so; a document that
    repeats is a sample each.  Columns named score or predicted are replaced.
    """
    sample = sample_labels(labels, id_col, label_col, max_toxic, max_clean)

    def gather(batches):
        for batch in batches:
            packed, styles, sizes = [], [], []
            for a, b, at, data in K.blocks(batch.column(0)):
                found = features(at, data)
                row, h = K.unique_in_rows(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
                cut = np.searchsorted(row, np.arange(b - a + 1))
                packed += [h[cut[i] : cut[i + 1]] for i in range(b - a)]
                styles.append(style_votes(at, data))
                sizes.append(distinct(found, b - a))
            s = np.concatenate(styles)
            yield pa.RecordBatch.from_arrays([batch.column(1), binary(packed), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(np.concatenate(sizes), pa.int64())], ["y", "h", "s0", "s1", "size"])

    known = docs.select(col(id_col).alias("id"), col(text_col).alias("t")).join(F.broadcast(sample), "id").select("t", F.col("y").cast("int").alias("y"))
    rows = known.mapInArrow(gather, "y int, h binary, s0 boolean, s1 boolean, size long").limit(4 * (max_toxic + max_clean)).toPandas()  # bounded by the sample
    y = rows["y"].to_numpy() if len(rows) else np.zeros(0, np.int64)
    model = None
    if len(set(y.tolist())) == 2:
        model = train([np.frombuffer(x, np.uint64) for x in rows["h"]], rows[["s0", "s1"]].to_numpy(), rows["size"].to_numpy(), y, max_features)
    del rows
    keys, weights, bias, slope = (model["keys"], model["weights"], model["bias"], model["size"]) if model else (np.zeros(0, np.uint64), np.zeros(0), -np.inf, 0.0)

    def score(batch):
        out = []
        for a, b, at, data in K.blocks(batch.column(batch.schema.get_field_index(text_col))):
            places, rows = [], []
            found = features(at, data)
            sizes = distinct(found, b - a)
            for row, h in found:
                hit, i = in_sorted(keys, h)
                places.append(i)
                rows.append(row[hit])
            pair = np.unique(np.concatenate(rows) * max(1, len(keys)) + np.concatenate(places))
            out.append(np.bincount(pair // max(1, len(keys)), weights[pair % max(1, len(keys))], b - a) + bias + slope * np.log1p(sizes))
        s = np.concatenate(out)
        s = np.where(np.isneginf(s), 0.0, sigmoid(s))
        return {"score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))}

    return extend(docs, score, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def held_out(id_col: str, folds: int, fold: int):
    return F.pmod(F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 3, 1))
    return score_toxicity(docs, labels).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")
