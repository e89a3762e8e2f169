"""Small corpora and plain reference implementations."""

import random
import re

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return (text or "").translate(UP)


def corpus(seed=1, n=60, vocabulary=40, words=(0, 80)):
    """Random texts with copies, near copies, shared lines, odd spaces and letters of several scripts."""
    rng = random.Random(seed)
    vocab = [f"w{k}" if k % 3 else f"Été{k}" for k in range(vocabulary)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.35:
            w = (rng.choice(texts) or "x").split(" ")
            w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
        else:
            t = "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "  ", "\t", "\n", " \n", ", "]) for _ in range(rng.randint(*words)))
            texts.append(t)
    return texts


def thue_morse(n=512, letters="xy"):
    """A string and its complement, which share a polynomial hash modulo 2**64 whatever the base."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


_ONE, _OTHER = thue_morse()
#: Texts that every operator must take.
ODD = [None, "", " ", "\n\n", "a", "Ünï çödé 漢字 عربى", "x" * 50_000, "word " * 5_000, "\x00\x01", "tie tie tie", "tie tie tie", _ONE, _ONE, _OTHER]


def documents(spark, texts, extra=False):
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 5 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    if extra:  # a null id, a repeated row, and columns whose names clash with those the operators add
        df = df.unionByName(spark.createDataFrame([(None, "no id here", "en", "src0"), (1, texts[1], "en", "src1")], df.schema))
        for c in ("n_words", "Kept", "score", "n_lines", "a.b", "h", "shard", "_row", "topic", "probability", "spans", "items", "node", "n", "_m1", "_m1_0", "m1", "gone_id"):
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("clash"))
    return df
