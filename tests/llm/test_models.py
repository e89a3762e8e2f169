"""Language model, toxicity, language id, mixing, URL rules and page text."""

import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import html_text, langid, mixing, ngram, textkit, toxicity, url_rules

from .helpers import ODD, WORD, corpus, documents, lower


def tokens(t):
    return [*WORD.findall(lower(t)), None]


class PlainModel:
    """Interpolated absolute discounting over a dict of counts, each part coded as the trie codes it."""

    def __init__(self, texts, order):
        self.c, self.after, self.order = Counter(), defaultdict(Counter), order
        for t in texts:
            w = tokens(t)
            self.c.update(w)
            for m in range(2, order + 1):
                for i in range(len(w) - m + 1):
                    self.after[tuple(w[i : i + m - 1])][w[i + m - 1]] += 1
        self.n, once = sum(self.c.values()), sum(x == 1 for x in self.c.values())
        self.unknown = (once + 1) / (self.n + once + 1)
        self.coded = lambda p: float(ngram.LEVELS[ngram.quantise(np.array([p]))[0]])

    def p(self, context, w):
        p = self.coded((1 - self.unknown) * self.c[w] / self.n) if self.c[w] else self.unknown
        for m in range(1, self.order):
            seen = self.after.get(tuple(context[len(context) - m :])) if m <= len(context) else None
            if not seen:
                break
            total = sum(seen.values())
            p = (self.coded((seen[w] - ngram.DISCOUNT) / total) if seen[w] else 0) + self.coded(ngram.DISCOUNT * len(seen) / total) * p
        return min(p, 1.0)

    def score(self, t):
        w = tokens(t)
        return sum(math.log10(self.p(w[max(0, k - self.order + 1) : k], x)) for k, x in enumerate(w))


@pytest.mark.parametrize("order,vocabulary", [(2, 300), (3, 300), (3, 20), (4, 60), (3, 0)])
def test_language_model(spark, order, vocabulary):
    """Hot words, hot pairs and cold ones (20 words make all hot), against plain counts; with nothing to learn from, too."""
    texts = ODD + corpus(2, 80, vocabulary or 9)
    df = documents(spark, texts)
    train = df.where(F.lit(vocabulary > 0) & (F.col("doc_id") % 3 > 0))
    found = {r.doc_id: r for r in ngram.score_texts(df, train, order=order).collect()}
    model = PlainModel([t for i, t in enumerate(texts) if i % 3] if vocabulary else [], order)
    for i, t in enumerate(texts):
        w, r = tokens(t), found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(model.c[x] > 0 for x in w), model.n)
        assert r.base_score == pytest.approx(sum(math.log10((model.c[x] + 1) / (model.n + len(model.c) + 1)) for x in w), rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(model.score(t) if model.n else 0, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_model_is_a_distribution(spark, order):
    """The probabilities of all tokens after a context sum to one, up to the codes (7 % each at most)."""
    texts = ["a b c a b d", "a c", "b a", "e a b"] * 3
    words = ["a", "b", "c", "d", "e", "unseen"]
    contexts = ["", "a", "a b", "c a", "e", "d b", "unseen"]
    texts_of = [(c, f"{c} {w}".strip()) for c in contexts for w in words] + [(c, c) for c in contexts]
    asked = spark.createDataFrame(texts_of, "c string, text string")
    # p(w | c) = p(c w end) / (p(c) p(end | c w)): asked for by scores of texts that end after w, less what follows
    model = PlainModel(texts, order)
    got = {r.text: r.score for r in ngram.score_texts(asked, documents(spark, texts), order=order).collect()}
    for c in contexts:
        head = c.split()
        end = lambda w: math.log10(model.p(w[-(order - 1) :], None))
        before = got[c] - end(head)
        total = 10 ** end(head) + sum(10 ** (got[f"{c} {w}".strip()] - before - end([*head, w])) for w in words)
        assert total == pytest.approx(1, abs=0.08), c


def test_collisions_of_polynomials():
    """Two strings (Thue and Morse's) that share every polynomial hash modulo 2**64."""
    same, one, other = ODD[-3:]
    data = np.frombuffer((one + other).encode(), np.uint8)
    a, b = textkit.span_hash(data, np.array([0, 512]), np.array([512, 1024])).tolist()
    assert len(one) == len(other) == 512 and one == same and a != b
    words = sorted({f"{x}{k}"[:n] for x in "ab\0" for k in range(3000) for n in range(9)})
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) for w in words])
    assert len(np.unique(textkit.span_hash(data, np.append(0, end[:-1]), end))) == len(words)


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"word{rng.randrange(3000)}" for _ in range(rng.randint(20, 120))]
        bad = rng.random() < 0.2
        for _ in range(rng.randint(2, 6) if bad else 0):
            w[rng.randrange(len(w))] = f"grumbo{rng.choice('abcdefghijkl')}{rng.choice('xyz')}"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_finds_inflected_insults(spark):
    rows, labels = toxic_corpus(900, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels[:600], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, known).collect()}
    truth = dict(labels)
    held = range(600, 900)
    caught = [i for i in held if found[i].predicted]
    assert sum(truth[i] for i in caught) >= 0.9 * sum(truth[i] for i in held)
    assert sum(1 - truth[i] for i in caught) <= 2
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())


def test_toxicity_odd_inputs(spark):
    df = documents(spark, ODD, extra=True)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_toxicity(df, none).collect()} == {0.0}
    one_class = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 5)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(df, one_class).count() == len(ODD) + 2
    assert toxicity.score_toxicity(df.limit(0), one_class).count() == 0


def test_label_model_weighs_correlated_voters_once():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    noisy = lambda: np.where(rng.random(4000) < 0.2, ~y, y)
    a, b = noisy(), noisy()
    labels = np.where(rng.random(4000) < 0.03, ~y, y).astype(int)
    model = toxicity.LabelModel(np.stack([a, a, a, b], 1), labels)
    assert model.correlations[0, 1] > 0.8 and abs(model.correlations[0, 3]) < 0.2
    assert model.weights[:3].sum() == pytest.approx(model.weights[3], rel=0.35)
    assert ((model.posterior > 0.5) == y).mean() > 0.95


LANGS = {
    "en": "the of and to in is that for with on this are was they have from what there their which people would about could".split(),
    "de": "der die und das ist nicht mit für auf eine auch werden dass wird sich noch schon über können müssen zwischen".split(),
    "fr": "le la les des une est dans pour que qui sur avec sont pas être fait plus cette mais nous vous très".split(),
    "es": "el los las una que para con por está más como pero sus fue muy también hasta desde nosotros años".split(),
    "fi": "ja on ei se että hän oli mutta kun niin myös sitä tämä ovat mitä minä sinä kanssa jälkeen".split(),
}


def test_labelled_sample_repeats(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    found = [sorted(map(tuple, toxicity.sample_labels(rows.repartition(n), "doc_id", "toxic", 100, 200).collect())) for n in (2, 7)]
    assert found[0] == found[1] and [sum(y == k for _, y in found[0]) for k in (1, 0)] == [100, 200]


def test_language_id(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(LANGS[y], k=rng.randint(4, 60))), y) for i, y in enumerate(sorted(LANGS) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(df.drop("lang"), df.where("doc_id < 200"), max_sample=300).join(df.select("doc_id", "lang"), "doc_id").where("doc_id >= 200").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_id_odd_inputs(spark):
    df = documents(spark, ODD + ["123 456", "漢字"], extra=True)
    known = spark.createDataFrame([("the of and", "en"), ("der die das", "de"), (None, "fr"), ("x", None)], "text string, lang string")
    found = {r.text: r for r in langid.identify(df, known, max_sample=10_000).collect()}
    for t in (None, "", "123 456", "\x00\x01"):
        assert (found[t].lang_pred, found[t].score) == ("und", 0.0)
    assert found["漢字"].lang_pred in ("en", "de")
    assert {r.lang_pred for r in langid.identify(df, known.limit(0)).collect()} == {"und"}
    assert langid.identify(df.limit(0), known).count() == 0


def test_families_come_first():
    x = np.eye(6, dtype=np.float32)
    model = langid.Hierarchy(x, np.array(["en", "de", "fr", "es", "fi", "fi"]))
    assert model.families == ["germanic", "romance", "uralic"]
    assert model.predict(x)[0].tolist() == ["en", "de", "fr", "es", "fi", "fi"]


def test_mixing_meets_its_targets(spark):
    rng = random.Random(0)
    rows = [(i, "w " * rng.randint(5, 40), rng.choice("ab"), rng.choice("xxxy")) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    share = lambda d: spark.createDataFrame(list(d.items()), "value string, share double")
    want = {"m1": {"a": 0.6, "b": 0.4}, "m2": {"x": 0.6, "y": 0.4}, "m3": {"all": 1.0}}
    out = mixing.mix_sources(df, topic=F.lit("all"), targets={k: share(v) for k, v in want.items()}, rate=0.4).persist()
    total = out.agg(F.sum(F.col("n_tokens") * F.col("probability"))).first()[0]
    assert total == pytest.approx(0.4 * out.agg(F.sum("n_tokens")).first()[0], rel=1e-6)
    for c, m in (("source", "m1"), ("lang", "m2")):
        for r in out.groupBy(c).agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("t"), F.sum(F.when(F.col("sampled"), F.col("n_tokens")).otherwise(0)).alias("s")).collect():
            assert r.t / total == pytest.approx(want[m][r[c]], rel=1e-3)
            assert r.s / total == pytest.approx(want[m][r[c]], rel=0.12)
    big = mixing.mix_sources(df, topic=F.lit("all"), targets={k: share(v) for k, v in want.items()}, rate=0.4, small=0)
    assert sorted(map(tuple, big.select("doc_id", F.round("probability", 9)).collect())) == sorted(map(tuple, out.select("doc_id", F.round("probability", 9)).collect()))


def test_mixing_odd_inputs(spark):
    df = documents(spark, ODD, extra=True)
    out = mixing.mix_sources(df).collect()
    assert len(out) == len(ODD) + 2 and all(0 <= r.probability <= 1 for r in out)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def plain_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = lower(rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[3:] if fit else (None, "allow")))


def test_url_rules(spark):
    rng = random.Random(5)
    hosts = ["org", "a.org", "b.a.org", "xa.org", "com", "A.Com", "a-b.org", "a.org:80", ""]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/x', '/x/y', '/xy/1', '/é/z'])}{rng.choice(['', '?q=/x', '#f'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "a://b://c/x"]
    rules = [("org", "/", "allow"), ("a.org", "/x", "block"), ("a.org", "/x/", "allow"), ("b.a.org", "", "block"), ("com", "/x", "block"), ("com", "/x", "allow"), ("a.com", "/", "allow"), (None, "/", "block"), ("", "/", "block")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("Rule", F.lit("clash"))
    for buckets in (1, 5, 40):
        found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.match_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"), buckets=buckets).collect()}
        assert found == {i: plain_rule(u, [r for r in rules if r[0]]) for i, u in enumerate(urls)}
    assert url_rules.match_urls(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert url_rules.match_urls(df, spark.createDataFrame([], "host string, path string, verdict string")).where("rule is not null").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></ul></nav>
<!-- <p>not shown</p> --><div class="ad">Buy</div><article class="post"><header><h1>Title &amp; more</h1></header><p>One <b>two</b>
 three.<p>Caf&eacute;&nbsp;x &lt;tag&gt;<br>next<ul><li>item</li></ul><div class="share-bar">Share</div><table><tr><td>a<td>b</table>
<script>var x = "</p><p>no</p>";</script><aside>Side</aside><section class="comments"><p>Nice!</p></section><form><p>Sign up</p></form></article>
<footer>&copy; us</footer></body></html>"""


def test_page_text(spark):
    plain = "<body><div>Menu</div><p>{}</p><p>shared quote</p><div>Bottom line</div></body>"
    rows = [
        (1, "http://h.org/a/1", PAGE), (2, "http://h.org/a/2", PAGE), (3, "http://p.org/1", plain.format("first text")), (4, "http://p.org/2", plain.format("second text")), (5, "http://alone.org/", plain.format("third")),
        (6, None, None), (7, "x", ""), (8, "y", "<p>open <b>text & more &am"), (9, "z", "no tags"), (10, "w", "<" * 20),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("N_chars", F.lit("clash"))
    found = {r.page_id: r for r in html_text.extract_text(df).collect()}
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found.values())
    body = "Title & more\nOne two three.\nCafé x <tag> next\nitem\na b"
    assert found[1].text == found[2].text == body
    assert found[3].text == "first text" and found[4].text == "second text"
    assert found[5].text == "Menu\nthird\nshared quote\nBottom line"
    assert found[6].text == found[7].text == "" and found[8].text == "open text & more &am" and found[9].text == "no tags"
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_page_text_beside_article(spark):
    """Beside an article one neighbour decides; in it all of them, and three at least; versions of a page have no say in it."""
    page = "<body><div>Menu</div><article><p>{}</p><p>quote</p><p>{}</p></article><p>{}</p><div>Bottom</div></body>"
    rows = [(k, f"http://h.org/{k}", page.format(f"body {k}", f"more {k}", f"note {k}")) for k in range(5)]
    rows += [(10 + k, f"http://two.org/{k}", page.format(f"body {k}", f"more {k}", f"note {k}")) for k in range(2)]
    rows += [(20 + k, f"http://same.org/{k}", page.format("body", f"more {k}", f"note {k}")) for k in range(5)]
    found = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {k: f"body {k}\n{'quote' if k in (0, 4) else ''}\nmore {k}\nnote {k}".replace("\n\n", "\n") for k in range(5)} | {10 + k: f"body {k}\nquote\nmore {k}\nnote {k}" for k in range(2)}
    assert found == want | {20 + k: f"body\nquote\nmore {k}\nnote {k}" for k in range(5)}


def plain_common(a, b):
    """A longest common subsequence by the whole table: indexes of a, as the walk back from the ends finds them."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("reach", [1, 2])
def test_page_text_of_copies_and_range_edges(spark, reach):
    """The nearest pages of other content are compared, whatever the ranges are."""
    rng = random.Random(4)
    page = '<body><div class="ad">{}</div><div>Menu {}</div><article><p>{}</p><p>{}</p></article><p>{}</p><div>Bottom</div></body>'
    zones = [1, 2, 2, 1, 1]
    rows, plain = [], []
    for h in range(3):
        k = 0
        while k < 40:
            size = rng.choice([1, 1, 2, 3, 15])  # so many in a row are copies; some under one path
            body, menu, quote, note, same = f"body {h} {k}", rng.choice("ab"), f"quote {rng.randint(0, 2)}", f"note {rng.randint(0, 5)}", rng.random() < 0.5
            for j in range(size):
                path = f"/{'xyz'[k * 3 // 60]}/{k if same else k + j:03d}"
                rows.append((len(rows), f"http://h{h}.org{path}?utm={j}", page.format(rng.random(), menu, body, quote, note)))
                plain.append((h, path, [f"Menu {menu}", body, quote, note, "Bottom"]))
            k += size
    want = {}
    for i, (h, path, lines) in enumerate(plain):
        others = []
        for side in (plain[:i][::-1], plain[i + 1 :]):
            runs, last = [], lines
            for p in side:
                if p[0] != h or len(runs) == reach:
                    break
                if p[2] != last:
                    runs.append(p[2])
                    last = p[2]
            others += runs
        shared = [{x for x, y in zip(lines, o) if x == y} for o in others]  # each line has one place here
        votes = [s for s in shared if len(s & set(lines[1:3])) <= 1]
        keep = []
        for z, x in zip(zones, lines):
            n = sum(x in s for s in votes)
            if not any(x in s for s in shared) if z == 1 else not (len(votes) >= 3 and n == len(votes)):
                keep.append(x)
        want[i] = "\n".join(keep)
    rows += [(1000 + k, f"http://copies.org/{k}", page.format(k, "a", "only", "text", "x")) for k in range(30)] + [(1000, "http://copies.org/0", page.format(0, "a", "only", "text", "x"))] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for buckets in (1, 4, 16, 64):
        found = [(r.page_id, r.text) for r in html_text.extract_text(df, buckets=buckets, reach=reach).collect()]
        assert len(found) == len(rows)
        assert {i: t for i, t in found if i < 1000} == want
        assert {t for i, t in found if i >= 1000} == {"Menu a\nonly\ntext\nx\nBottom"}


def test_common_lines():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        found = sorted(html_text.common_lines(a, b))
        assert len(found) == plain_common(a, b)
        it = iter(b)
        assert all(a[i] in it for i in found)
    many = [["same", "same", f"x{k}"][: 2 + k % 2] for k in range(4000)]
    a, b = ([x for row in many[::s] for x in row] for s in (1, -1))  # thousands of equal lines on both sides
    began = time.time()
    found = html_text.common_lines(["left", *a, "left"], ["right", *b, "right"])
    assert len(found) >= 8000 and time.time() - began < 20


def test_folds(spark):
    df = documents(spark, ["a"] * 20)
    got = {r.doc_id: r.h for r in df.select("doc_id", toxicity.held_out("doc_id", 3, 1).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(20)}
