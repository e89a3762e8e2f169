"""Language identification in two levels: the family, then one-versus-one linear SVMs inside it.

Features are counts of hashed byte pairs and triples of the words (A-Z lower-cased, all that is no letter a space), their
square roots scaled to length one.  Training documents are a sample of bounded size, each once as a whole and once as a
short run of words, so that short texts are known too.  The SVMs (squared hinge loss) are fitted on the driver
and score every whole text in one pass without a shuffle.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .frames import binary, col, extend, spread

DIMS = 4096
#: Families of common languages; a language that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "indic": "hi mr ne bn pa gu ur sa",
    "iranian": "fa ku ps tg",
    "turkic": "tr az kk uz ky tt",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
    "sinitic": "zh yue wuu",
    "celtic": "ga cy gd br",
    "baltic": "lt lv",
}
_FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs.split()}

_FOLD = np.full(256, 32, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def counts(at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Rows x DIMS: square roots of the counts of byte pairs and triples, each row of length one (or zero)."""
    n = len(at) - 1
    x = _FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    out = np.zeros((n, DIMS), np.float32)
    for size in (2, 3):
        if len(x) < size:
            continue
        k = len(x) - size + 1
        h = x[:k].copy()
        for i in range(1, size):
            h = h * np.uint32(257) + x[i : i + k]
        inside = (row[:k] == row[size - 1 :]) & ~((x[:k] == 32) & (x[1 : k + 1] == 32))
        place = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 11)
        place = place.astype(np.int64) + (DIMS // 2) * (size - 2)
        out += np.bincount(row[:k][inside] * DIMS + place[inside], minlength=n * DIMS).reshape(n, DIMS)
    np.sqrt(out, out=out)
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.maximum(norm, 1e-9)[:, None]


def has_letter(at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Whether each row has a letter in Unicode's sense."""
    running = np.append(0, np.cumsum(((data | 32) >= 0x61) & ((data | 32) <= 0x7A) & (data < 0x80)))
    out = running[at[1:]] > running[at[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def snippet(text: bytes, key: int) -> bytes:
    """A run of 3 to 14 words of a text, chosen by key."""
    words = text.split()
    n = 3 + key % 12
    a = (key // 12) % max(1, len(words) - n + 1)
    return b" ".join(words[a : a + n])


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 2e-3, rounds: int = 150) -> np.ndarray:
    """Weights (and a bias, last) that minimise the mean squared hinge loss, classes weighed alike; y is 1 or -1."""
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = last = np.zeros(x.shape[1] + 1, np.float32)
    for k in range(rounds):
        u = w + np.float32(k / (k + 3)) * (w - last)
        slack = np.maximum(0, 1 - y * (x @ u[:-1] + u[-1]))
        g = -2 * c * y * slack
        last, w = w, u - np.float32(0.25) * np.append(g @ x + 2 * penalty * u[:-1], g.sum()).astype(np.float32)
    return w


class Hierarchy:
    """One-versus-one votes over families, then over the languages of the family that won."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.langs = sorted(set(langs.tolist()))
        family = {lang: _FAMILY.get(lang.lower(), f"only {lang}") for lang in self.langs}
        self.families = sorted(set(family.values()))
        of = np.array([family[lang] for lang in langs.tolist()])
        self.members = {f: [lang for lang in self.langs if family[lang] == f] for f in self.families}
        self.machines, self.scale = {}, {}
        for level, names, mine in [("", self.families, of), *((f, m, langs) for f, m in self.members.items())]:
            for a, b in combinations(names, 2):
                at = (mine == a) | (mine == b)
                w = svm(x[at], np.where(mine[at] == a, 1, -1).astype(np.float32))
                self.machines[level, a, b] = w
                self.scale[level, a, b] = 3.0

    def choose(self, level: str, names: list[str], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the winner, its share of the pairs' belief) of each row."""
        belief = np.zeros((len(x), len(names)))
        if len(names) == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        for (i, a), (j, b) in combinations(enumerate(names), 2):
            w = self.machines[level, a, b]
            p = 1 / (1 + np.exp(-self.scale[level, a, b] * np.clip(x @ w[:-1] + w[-1], -5, 5)))
            belief[:, i] += p
            belief[:, j] += 1 - p
        best = belief.argmax(1)
        return best, belief.max(1) / (len(names) - 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        won, sure = self.choose("", self.families, x)
        out, score = np.empty(len(x), object), np.zeros(len(x))
        for k in np.unique(won).tolist():
            at = np.flatnonzero(won == k)
            names = self.members[self.families[k]]
            i, p = self.choose(self.families[k], names, x[at])
            out[at], score[at] = np.array(names, object)[i], sure[at] * p
        return out, np.clip(score, 0, 1)


def identify(docs: DataFrame, known: DataFrame, text_col: str = "text", lang_col: str = "lang", max_sample: int = 4000, max_langs: int = 200) -> DataFrame:
    """docs with lang_pred and score (0 to 1).

    known: documents with their language.  About max_sample of them, spread evenly over the max_langs most common
    languages, are learned from.  A text that is null or has no letter is `und` with score 0, and so is every text if nothing
    can be learned.  Null languages teach nothing.  Columns of the new names are replaced.
    """
    taught = known.select(col(text_col).alias("t"), col(lang_col).cast("string").alias("y")).where("y is not null and t is not null")
    n = {r.y: r.n for r in taught.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(max_langs).collect()}
    share = F.create_map(*[F.lit(v) for y, k in n.items() for v in (y, min(1.0, max_sample / len(n) / k))]) if n else F.create_map(F.lit(""), F.lit(0.0))
    u = F.pmod(F.xxhash64("t", F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    picked = taught.where(u < F.coalesce(share[F.col("y")], F.lit(0.0)))

    def gather(batches):
        for batch in batches:
            packed, labels = [], []
            for a, b, at, data in K.blocks(batch.column(0), 1 << 19):
                short = pa.array([snippet(data[at[i] : at[i + 1]].tobytes(), int(at[i + 1] - at[i]) * 7919 + i * 31) for i in range(b - a)], pa.binary())
                y = batch.column(1).slice(a, b - a).to_pylist()
                for whole_at, whole in ((at, data), K.raw(short)):
                    x = counts(whole_at, whole)
                    for i in np.flatnonzero(np.einsum("ij->i", x) > 0):
                        j = np.flatnonzero(x[i])
                        packed.append(np.concatenate([j.astype(np.float32), x[i, j]]))
                        labels.append(y[i])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), binary(packed)], ["y", "x"])

    rows = picked.orderBy(u, "t", "y").limit(2 * max_sample).mapInArrow(gather, "y string, x binary").toPandas()  # bounded by max_sample
    model = None
    if len(rows):
        x = np.zeros((len(rows), DIMS), np.float32)
        for i, v in enumerate(rows["x"]):
            v = np.frombuffer(v, np.float32)
            x[i, v[: len(v) // 2].astype(np.int64)] = v[len(v) // 2 :]
        model = Hierarchy(x, rows["y"].to_numpy())
    del rows

    def predict(batch):
        lang, score = [], []
        for a, b, at, data in K.blocks(batch.column(batch.schema.get_field_index(text_col)), 1 << 19):
            out, s = (model.predict(counts(at, data))) if model else (np.full(b - a, "und", object), np.zeros(b - a))
            blank = ~has_letter(at, data)
            lang.append(np.where(blank, "und", out))
            score.append(np.where(blank, 0.0, s))
        return {"lang_pred": pa.array(np.concatenate(lang), pa.string()), "score": pa.array(np.concatenate(score), pa.float64())}

    return extend(docs, predict, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    from .toxicity import held_out

    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"), "text")
    known = docs.where(~held_out("doc_id", 4, 2))
    return identify(docs.select("doc_id", "text"), known).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
