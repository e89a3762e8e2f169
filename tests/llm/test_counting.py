"""Line dedup, quality rules, decontamination and near duplicates against plain versions."""

import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, elias_fano, graph, line_dedup, near_dedup, quality, textkit

from .helpers import ALNUM, ODD, WORD, corpus, documents, lower

TEXTS = ODD + corpus(5)
STRIP = " \t\n\x0b\x0c\r"


def plain_line_dedup(texts, least=20, often=3):
    holders = defaultdict(set)
    key = lambda line: lower(line.strip(STRIP))
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    out = {}
    for i, t in enumerate(texts):
        parts = (t or "").split("\n")
        keep = [p for p in parts if not (len(holders.get(key(p), ())) >= often and i != max(holders[key(p)]))]
        out[i] = (len(parts), len(parts) - len(keep), "\n".join(keep))
    return out


@pytest.mark.parametrize("least,often", [(20, 3), (3, 1), (1, 2)])
def test_line_dedup(spark, least, often):
    texts = TEXTS + ["a line that is long enough to count\nx"] * 4 + ["A LINE that is long enough to count  \ny"]
    found = line_dedup.dedup_lines(documents(spark, texts), min_chars=least, min_docs=often).collect()
    want = plain_line_dedup(texts, least, often)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in found} == want
    assert {r.doc_id for r in found if r.text is None} == {0}


def test_perfect_hash():
    keys = np.unique(textkit.mix(np.arange(20_000, dtype=np.uint64)))
    mph, sizes = line_dedup.build_mph(keys)
    assert sorted(line_dedup.probe_mph(mph, sizes, keys).tolist()) == list(range(len(keys)))
    empty, none = line_dedup.build_mph(keys[:0])
    assert (line_dedup.probe_mph(empty, none, keys[:3]) == -1).all()


def test_condensed_keeps_what_decides():
    h = np.array([5] * 10 + [7], np.uint64)
    d = np.array([3, 1, 2, 9, 9, 4, 8, 1, 0, 6, 2])
    a, b = line_dedup.condensed([(h, d)], 3)
    assert a.tolist() == [5, 5, 5, 5, 7] and b.tolist() == [0, 1, 2, 9, 2]


def plain_measures(t):
    t = t or ""
    w = WORD.findall(t)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(g)
    hit = {i + k for i, x in enumerate(g) if c[x] > 1 for k in range(3)}
    lines = Counter(x for x in t.split("\n") if WORD.search(x))
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), sum(lines.values()) - len(lines), len(hit)


def plain_quality(rows, least, share):
    host_texts, holders = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        host_texts[s].add(t or "")
        for x in (t or "").split("\n"):
            if x.strip(STRIP):
                holders[s, lower(x.strip(STRIP))].add(t)
    out = {}
    for i, t, s in rows:
        m = plain_measures(t)
        drop = lambda x: len(holders.get((s, lower(x.strip(STRIP))), ())) > max(least, share * len(host_texts[s]))  # noqa: E731, B023
        lost = [x for x in (t or "").split("\n") if drop(x)]
        gone = sum(len(WORD.findall(x)) for x in lost)
        failed = m[0] < 50 or 2 * m[4] > m[0]
        out[i] = (*m, len(lost), gone, failed, not failed and m[0] - gone >= 0.2 * m[0])
    return out


@pytest.mark.parametrize("least,share", [(20, 0.01), (2, 0.01), (1, 0.2)])
def test_quality_rules(spark, least, share):
    texts = TEXTS + [f"shared line of the host\n{' '.join(f'u{i}x{k}' for k in range(60))}" for i in range(12)] + [" &#* ".join(["a"] * 30)]
    df = documents(spark, texts)
    found = quality.quality_rules(df, least_docs=least, host_share=share).collect()
    want = plain_quality([(r.doc_id, r.text, r.source) for r in df.collect()], least, share)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "n_words_removed", "base_failed", "kept"]
    assert {r.doc_id: tuple(r[c] for c in names) for r in found} == want


BENCH = ["one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen", "short item", "", None, "short item", "tie tie tie", "w1 w2 w4", ODD[-2]]


def plain_windows(texts, items, window=13):
    pats = defaultdict(set)
    for k, t in items:
        w = ALNUM.findall(lower(t))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            pats[tuple(w[i : i + n])].add(k)
    out = {}
    for d, t in enumerate(texts):
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for n in {len(p) for p in pats}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in pats:
                    hit |= set(range(i, i + n))
                    found |= pats[tuple(w[i : i + n])]
        out[d] = (len(w), len(hit), ",".join(sorted(map(str, found))), hit)
    return out


@pytest.mark.parametrize("block", [20_000, 2])
def test_decontamination(spark, block):
    texts = TEXTS + [f"before {BENCH[0]} after", BENCH[0].upper().replace(" ", "--"), "a SHORT, item! and short item again", BENCH[0][:40]] * 2
    items = list(enumerate(BENCH)) + [(10, "short item"), (None, "before")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_windows(documents(spark, texts), bench, block_items=block)
    want = plain_windows(texts, [x for x in items if x[0] is not None])
    rows = found.collect()
    assert {r.doc_id: (r.n_words, r.n_hit, ",".join(r["items"])) for r in rows} == {d: v[:3] for d, v in want.items()}
    for r in rows:
        assert {k for s in r.spans for k in range(s.start, s.end)} == want[r.doc_id][3]
        for s in r.spans:
            piece = r.text.encode()[s.byte_start : s.byte_end].decode()
            assert ALNUM.findall(lower(piece)) == ALNUM.findall(lower(r.text))[s.start : s.end]
    cut = {r.doc_id: r.text for r in decontaminate.cut_spans(found).collect()}
    assert cut[len(TEXTS)] == "before  after" and cut[0] is None
    assert cut[len(TEXTS) + 2] == "a ! and  again"


def test_suffix_array_and_index():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 700):
        text = rng.integers(0, 4, n)
        text[-1] = 0
        key = lambda i: tuple((int(c), -1) if c else (0, j) for j, c in enumerate(text[i:], i))  # noqa: E731, B023
        trim = lambda i: list(itertools.takewhile(lambda v: v[0], key(i)))  # noqa: E731, B023
        ends = lambda i: (*[(c, 0) for c, _ in trim(i)], (0, i + len(trim(i))))  # noqa: E731, B023
        assert decontaminate.suffix_array(text, 2).tolist() == sorted(range(n), key=ends)
        index = decontaminate.FMIndex(text, 2)
        pats = [(1,), (2, 3), (1, 1, 2), (3, 3, 3, 1)]
        flat, size = np.concatenate(pats), np.array([len(p) for p in pats])
        live, lo, hi = index.search(flat, np.cumsum(size) - size, size)
        got = {pats[k]: sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(live, lo, hi)}
        want = {p: [i for i in range(n - len(p) + 1) if tuple(text[i : i + len(p)]) == p] for p in pats}
        assert got == {p: v for p, v in want.items() if v}


def plain_near(texts, words, percent=80):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_texts():
    rng = np.random.default_rng(4)
    base = [f"v{k}" for k in rng.integers(0, 500, 120)]
    family = []
    for k in range(25):  # a chain: not all are near the first
        base = base.copy()
        base[int(rng.integers(0, 120))] = f"new{k}"
        family.append(" ".join(base))
    return ODD + corpus(9, 40) + family


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(spark, words):
    texts = near_texts()
    found = near_dedup.near_duplicates(documents(spark, texts), words=words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_near(texts, words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_rows_of_near_duplicates_go_by_row(spark):
    """Null ids, an id with two texts, and repeated rows."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " end"), (2, b), (None, a), (3, c), (3, c), (None, "n " * 9), (None, "n " * 9), (4, ""), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = near_dedup.drop_near_duplicates(df)
    assert found.columns == df.columns
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [(1, a), (2, b), (3, c), (None, "n " * 9), (4, ""), (4, "")]))


def test_block_comparison_counts():
    rng = np.random.default_rng(1)
    a, b = ([np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(n)] for n in (5, 7))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert near_dedup.common_counts(a, b).tolist() == want == near_dedup.common_counts(a, b, 8).tolist()


def test_blocks_link_what_stars_miss(spark, tmp_path):
    """Members outside the pivot's component are compared with the rest of their bucket."""
    sets = {1: range(10), 2: range(100, 110), 3: range(101, 111), 4: range(200, 210)}
    folder = str(tmp_path)
    from cadenza.llm.shared import write

    nodes = np.array(sorted(sets), np.int64)
    order = [np.array(sorted(sets[n]), np.uint64) for n in nodes.tolist()]
    write(f"{folder}/s-0", {"node": nodes.view(np.uint64), "cut": np.append(0, np.cumsum([len(x) for x in order])), "sets": np.concatenate(order)})
    member = spark.createDataFrame([(7, n, 1, 10) for n in sets], "bucket long, node long, pivot long, n long")
    label = spark.createDataFrame([], "node long, root long")
    for most in (256, 1):
        found = near_dedup.link_blocks(near_dedup.block_pairs(member, label, most=most), near_dedup.Sets(f"{folder}/s", 1), 80)
        assert {tuple(r) for r in found.collect()} == {(2, 3)}


def test_components(spark, tmp_path):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    found = graph.components(spark.createDataFrame(chain, "a long, b long"), str(tmp_path))
    assert {r.node: r.root for r in found.collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, bound in ((0, 10), (1, 1), (500, 3), (1000, 1 << 40), (300, 1 << 64)):
        values = np.sort(rng.integers(0, min(bound, 1 << 63), n).astype(np.uint64))
        ef = elias_fano.EliasFano.build(values, bound)
        assert (ef.get(np.arange(n)) == values).all()
        x = np.concatenate([values, rng.integers(0, min(bound, 1 << 63), 50).astype(np.uint64)])
        at, hit = ef.successor(x)
        assert (at == np.searchsorted(values, x)).all() and (hit == np.isin(x, values)).all()
        if n > 1:
            i = rng.integers(0, n - 1, 400)
            a, b = ef.pair(i)
            assert (a == values[i]).all() and (b == values[i + 1]).all()
            first = rng.integers(0, n, len(x))
            last = first + rng.integers(0, n - first + 1)
            at, hit = ef.successor(x, first, last)
            for k in range(len(x)):
                part = values[first[k] : last[k]]
                assert hit[k] == (x[k] in part) and (not hit[k] or values[at[k]] == x[k] and first[k] <= at[k] < last[k])


@pytest.mark.parametrize("case", ["empty", "clash"])
def test_odd_tables(spark, case):
    df = documents(spark, TEXTS[:14], extra=True)
    df = df.limit(0) if case == "empty" else df
    bench = spark.createDataFrame([(0, "w1 w2")], "item_id long, text string")
    n = df.count()
    for made in (line_dedup.dedup_lines(df), quality.quality_rules(df), decontaminate.find_windows(df, bench), decontaminate.find_windows(df, bench.limit(0)), near_dedup.near_duplicates(df), near_dedup.drop_near_duplicates(df).unionByName(df.limit(0))):
        assert len({c.lower() for c in made.columns}) == len(made.columns)
        assert made.count() <= n
        if case == "clash" and "text" not in made.columns:
            assert made.count() == n
    if case == "clash":
        found = near_dedup.near_duplicates(df).where("doc_id is null").first()
        assert found.component_id is None and not found.kept
        assert "a.b" in quality.quality_rules(df).columns


@pytest.mark.parametrize("block", [1, 2, 20_000])
def test_item_ids_of_any_characters(spark, block):
    items = [("a\nb", "w1 w2"), ("a\nb", "w1 w2"), ("a", "w3 w4"), ("b", "w5"), ('q","', "w3 w4"), ("", "w1 w2"), (None, "w1"), ("é,\u2028", "w5")]
    texts = ["w1 w2 w3 w4", "w1 w2", "w5 w5", "none"]
    found = decontaminate.find_windows(documents(spark, texts), spark.createDataFrame(items, "item_id string, text string"), block_items=block)
    want = plain_windows(texts, [x for x in items if x[0] is not None])
    assert {r.doc_id: ",".join(r["items"]) for r in found.collect()} == {d: v[2] for d, v in want.items()}


@pytest.mark.parametrize("block", [1, 20_000])
def test_repeated_items_count_once(spark, block):
    bench = spark.createDataFrame([(7, "w1 w2"), (7, "w1 w2"), (7, "w3 w4"), (8, "w3 w4")], "item_id long, text string")
    found = decontaminate.find_windows(documents(spark, ["w1 w2 w3 w4", "w1 w2"]), bench, block_items=block)
    assert {r.doc_id: r["items"] for r in found.collect()} == {0: ["7", "8"], 1: ["7"]}


def test_digest(spark):
    row = line_dedup.dedup_lines(documents(spark, ["b"])).select(F.sha2("text", 256).alias("h")).first()
    assert row.h == hashlib.sha256(b"b").hexdigest()
