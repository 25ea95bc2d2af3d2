"""Language model, classifiers, mixing, extraction and the pipeline."""

import hashlib
import html
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare, duck
from pyspark.sql import functions as F

import corpus_pipeline
from wardspark.llm import common, decontam, html_text, katz, mixing, near_dups, quality, simhash, toxicity

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def good_turing(counts):
    """Factors for counts 1..k by the formula, for the largest k up to 5 that gives factors between 0 and 1; else a half for ones."""
    n = Counter(counts)
    for k in (5, 4, 3, 2, 1):
        if all(n[r] for r in range(1, k + 2)):
            cut = (k + 1) * n[k + 1] / n[1]
            factor = {r: ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut) if cut < 1 else 0 for r in range(1, k + 1)}
            if all(0 < x < 1 for x in factor.values()):
                return factor
    return {1: 0.5}


def plain_katz(rows, order=3):
    """Scores by dictionaries and recursion: (doc_id, held, n_tokens, n_known, N, base, score), and the distributions' sums."""
    docs = [(i, common.crc_of(i) % 7 == 2, [*common.words_of(t or ""), None]) for i, t in rows]
    after = defaultdict(Counter)  # by history, of no, one or two words
    for _, held, w in docs:
        if not held:
            for h2, h1, x in zip([None, None, *w], [None, *w], w):
                for h in ((), (h1,), (h2, h1)) if h1 is not None else ((), (h1,)):
                    after[h][x] += 1
    uni = after[()]
    big, v = sum(uni.values()), len(uni)
    factors = [good_turing([n for h, words in after.items() if len(h) == k for n in words.values()]) for k in range(3)]
    cut = lambda n, k: n * factors[k].get(n, 1.0)
    known = {}

    def history(h):
        """(divisor, alpha)"""
        if h not in known:
            n = sum(after[h].values())
            freed = n - sum(cut(x, len(h)) for x in after[h].values())
            total, left = (n, freed) if freed > 1e-9 else (n + 1, 1)
            known[h] = total, left / total / (1 - sum(p(h[1:], w) for w in after[h]) if h else 1)
        return known[h]

    def p(h, w):
        if h and h not in after:
            return p(h[1:], w)
        if not big:
            return 1.0
        total, alpha = history(h)
        if w in after[h]:
            return cut(after[h][w], len(h)) / total
        return alpha * (p(h[1:], w) if h else 1.0)

    out = []
    for i, held, w in docs:
        base = sum(math.log10((uni[x] + 1) / (big + v + 1)) for x in w)
        score = sum(math.log10(p((h2, h1)[2 - order + 1 :] if order > 1 else (), x)) for h2, h1, x in zip([None, None, *w], [None, *w], w))
        out.append((i, held, len(w), sum(x in uni for x in w), big, base, score))
    sums = [sum(p(h, w) for w in [*uni, "never seen"]) for h in list(after)[:40]]
    return out, sums


def same(got, want):
    key = lambda r: repr((r[0], r[2], round(r[5], 4)))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-9)


def test_katz(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    want, sums = plain_katz(rows)
    assert all(s == pytest.approx(1) for s in sums)
    got = katz.score(common.table(spark, SF, "documents")).collect()
    same(got, want)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    for order in (1, 2):
        same(katz.score(common.table(spark, SF, "documents"), order=order).collect(), plain_katz(rows, order)[0])
    same(katz.score(odd_docs).collect(), plain_katz([(r.doc_id, r.text) for r in odd_docs.collect()])[0])
    assert katz.score(no_docs).count() == 0
    held = spark.createDataFrame([(i, "a b") for i in range(40) if common.crc_of(i) % 7 == 2], "doc_id long, text string")
    assert {(r.train_tokens, r.score) for r in katz.score(held).collect()} == {(0, 0.0)}


def test_katz_frequent_words_and_many_slices(spark, tmp_path, monkeypatch):
    """Frequent middle words are dealt by their first words, their pairs meet by ranges; slices and owners are many."""
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["the", "the", "of", "a", f"w{rng.randrange(60)}", f"v{rng.randrange(3000)}"]) for _ in range(rng.randrange(60)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        same(katz.score(docs, folder=str(tmp_path)).collect(), plain_katz(rows)[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    frequent = {f.parent.name for f in tmp_path.glob("frequent/*/*.parquet")}
    assert len(frequent) >= 3 and len(list(tmp_path.glob("triples/*"))) > 10
    n = sum(r.n for r in spark.read.parquet(str(tmp_path / "triples")).groupBy("b").agg(F.sum("n").alias("n")).collect())
    assert n == sum(len(t.split()) for i, t in rows if common.crc_of(i) % 7 != 2)  # the first token of a text has no two words before it


def test_katz_runs():
    """Triples are ordered alike by one packed number and, where three do not fit into it, by three."""
    rng = np.random.default_rng(2)
    a, b, c = rng.integers(0, 9, (3, 500)).astype(np.int32)
    known = rng.random(500) < 0.8
    want = sorted(zip(b[known].tolist(), a[known].tolist(), c[known].tolist()))
    for size in (9, 1 << 22):
        order, heads, *distinct = katz._runs(a, b, c, known, size)
        assert list(zip(b[order].tolist(), a[order].tolist(), c[order].tolist())) == want
        x, y, z = (v.tolist() for v in distinct)
        assert list(zip(y, x, z)) == sorted(set(want)) and [want[h] for h in heads] == sorted(set(want))


def test_katz_equals_sql(spark):
    got, want = compare(spark, duck(SF), SF, katz.op1_katz, katz.SQL)
    assert got == want


def test_quality(spark, odd_docs, no_docs):
    labels = common.table(spark, SF01, "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.op9_quality(spark, SF01).collect()]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (common.crc_of(r.doc_id) % 4 == 2) for r in rows)
    good = [r.score for r in rows if r.held_out and truth.get(r.doc_id) == 1]
    poor = [r.score for r in rows if r.held_out and truth.get(r.doc_id) == 0]
    assert sum((g > p) + 0.5 * (g == p) for g in good for p in poor) / len(good) / len(poor) > 0.95
    assert quality.scored(odd_docs, labels).count() == odd_docs.count()
    assert {r.score for r in quality.scored(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(no_docs, labels).count() == 0
    kept = quality.keep_good(common.table(spark, SF01, "documents"), labels)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.predicted)


def test_quality_gradient():
    """The fitted network separates bags by one bad passage, which attention must find."""
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 6, 300)
    first = np.concatenate([[0], np.cumsum(sizes)])
    x = rng.normal(size=(first[-1], quality.FEATURES))
    y = rng.integers(0, 2, 300).astype(float)
    for k in np.flatnonzero(y == 0):
        x[first[k] + rng.integers(sizes[k]), 3] += 6
    model = quality.fit(x, first, y)
    logit = model.forward((x - model.mean) / model.std, first)[-1]
    assert ((logit > 0) == (y == 1)).mean() > 0.95


def differences(loss, values, step=1e-5):
    """Central differences of a loss over an array that it reads, changed in place."""
    out = np.zeros(values.size)
    flat = values.reshape(-1)
    for i in range(values.size):
        kept = flat[i]
        flat[i] = kept + step
        high = loss()
        flat[i] = kept - step
        out[i] = (high - loss()) / (2 * step)
        flat[i] = kept
    return out.reshape(values.shape)


def test_quality_against_plain_passes():
    """The forward pass by loops over passages, and the gradient by differences."""
    rng = np.random.default_rng(7)
    sizes = [1, 3, 2, 5]
    first = np.concatenate([[0], np.cumsum(sizes)])
    x, y = rng.normal(size=(first[-1], quality.FEATURES)), np.array([0.0, 1, 1, 0])
    draw = lambda *shape: rng.normal(0, 0.3, shape)
    p = {"W": draw(x.shape[1], quality.HIDDEN), "b": draw(quality.HIDDEN), "V": draw(quality.HIDDEN, quality.GATE), "U": draw(quality.HIDDEN, quality.GATE), "w": draw(quality.GATE), "c": draw(quality.HIDDEN), "d": draw(1)}
    model = quality.Model(np.zeros(x.shape[1]), np.ones(x.shape[1]), p)
    logits = model.forward(x, first)[-1]
    for k, (lo, hi) in enumerate(zip(first[:-1], first[1:])):
        hidden = [[math.tanh(sum(v * p["W"][f, j] for f, v in enumerate(row)) + p["b"][j]) for j in range(quality.HIDDEN)] for row in x[lo:hi]]
        gates = []
        for h in hidden:
            tanh = [math.tanh(sum(v * p["V"][i, j] for i, v in enumerate(h))) for j in range(quality.GATE)]
            open_ = [1 / (1 + math.exp(-sum(v * p["U"][i, j] for i, v in enumerate(h)))) for j in range(quality.GATE)]
            gates.append(math.exp(sum(a * b * c for a, b, c in zip(tanh, open_, p["w"]))))
        z = [sum(g * h[j] for g, h in zip(gates, hidden)) / sum(gates) for j in range(quality.HIDDEN)]
        assert logits[k] == pytest.approx(sum(a * b for a, b in zip(z, p["c"])) + p["d"][0])
    _, grad = quality.loss_and_gradient(model, x, first, y, 0.01)
    for name in p:
        assert np.allclose(grad[name], differences(lambda: quality.loss_and_gradient(model, x, first, y, 0.01)[0], p[name]), atol=1e-7)


def test_passage_features_by_hand():
    """Every passage of a long text counts; hashed sums follow the words, whatever their order."""
    words = [f"w{i}" for i in range(250)]
    x, first = quality.passages([" ".join(words), "", "a b A", "b a a"])
    assert first.tolist() == [0, 3, 4, 5, 6] and not x[3].any()
    assert np.allclose(x[4, quality.SURFACE :], x[5, quality.SURFACE :]) and np.allclose((x[4, quality.SURFACE :] * 3**0.5).round() % 1, 0)
    assert x[4, 1] > 0 and x[5, 1] == 0


def test_toxicity_against_plain_likelihood():
    """The likelihood by its formula, and the gradient by differences; thresholds stay in order."""
    rng = np.random.default_rng(8)
    k, n = 6, 12
    row, col = np.nonzero(rng.random((n, k)) < 0.5)
    grade, p = rng.integers(0, toxicity.GRADES, n), rng.normal(0, 0.5, k + toxicity.GRADES - 1)
    loss, grad = toxicity.loss_and_gradient(p, row, col, grade, 0.1)
    theta = toxicity.thresholds_of(p, k)
    assert (np.diff(theta) > 0).all()
    plain = 0.0
    for i in range(n):
        s = sum(p[c] for r, c in zip(row, col) if r == i)
        below = [0.0, *(1 / (1 + math.exp(s - t)) for t in theta), 1.0]
        plain -= math.log(below[grade[i] + 1] - below[grade[i]]) / n
    assert loss == pytest.approx(plain + 0.05 * sum(w * w for w in p[:k]))
    assert np.allclose(grad, differences(lambda: toxicity.loss_and_gradient(p, row, col, grade, 0.1)[0], p), atol=1e-7)
    terms = np.arange(100, 100 + k)
    model = toxicity.Model(terms, p[:k], theta)
    assert np.allclose(model.grades(np.array([0.3]))[0], np.diff([0.0, *(1 / (1 + np.exp(0.3 - theta))), 1.0]))


def test_toxicity(spark, odd_docs, no_docs):
    docs, labels = common.table(spark, SF01, "documents"), common.table(spark, SF01, "labels")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.scored(docs, labels, common.crc_mod(F.col("doc_id"), 4) != 2).collect()
    held = [(r.expected_severity, truth[r.doc_id]) for r in rows if common.crc_of(r.doc_id) % 4 == 2 and r.doc_id in truth]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    assert sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg) > 0.8
    assert all(0 <= r.expected_severity <= 3 and r.toxic == (r.p_toxic >= 0.5) for r in rows)
    assert toxicity.scored(odd_docs, labels).count() == odd_docs.count()
    assert {r.grade for r in toxicity.scored(odd_docs, labels.limit(0)).collect()} == {0}
    assert toxicity.scored(no_docs, labels).count() == 0


def test_mixing(spark, odd_docs, no_docs):
    rows = mixing.op10_mixing(spark, SF01).collect()
    total = sum(r.n_tokens for r in rows)
    for d in mixing.DIMENSIONS:
        natural, raked = Counter(), Counter()
        for r in rows:
            natural[r[d]] += r.n_tokens / total
            raked[r[d]] += r.n_tokens * r.weight / total
        whole = sum(x**mixing.POWER for x in natural.values())
        for k, x in natural.items():
            assert raked[k] == pytest.approx(x**mixing.POWER / whole, abs=1e-5)
        drawn = sum(r.n_tokens * r.probability for r in rows)
        got = Counter()
        for r in rows:
            got[r[d]] += r.n_tokens * r.probability / drawn
        assert sum(abs(got[k] - x**mixing.POWER / whole) for k, x in natural.items()) / 2 <= mixing.MISS + 1e-6
    expected = sum(r.n_tokens * r.probability for r in rows)
    assert abs(sum(r.n_tokens for r in rows if r.selected) - expected) / total < 0.06
    docs = common.table(spark, SF01, "documents")
    rows = mixing.weighed(docs, budget=0.8).collect()
    assert sum(r.n_tokens * r.probability for r in rows) / total == pytest.approx(0.8, abs=1e-9)
    partial = {round(r.probability / r.weight, 9) for r in rows if r.probability < 1}
    assert len(partial) == 1
    kept = sum(r.n_tokens for r in rows if r.selected) / total
    assert abs(kept - 0.8) < 0.06
    words = {r.doc_id: len(common.words_of(r.text)) for r in common.table(spark, SF01, "documents").collect()}
    assert all(words[r.doc_id] == r.n_tokens for r in rows)
    assert mixing.weighed(odd_docs).count() == odd_docs.count() and mixing.weighed(no_docs).count() == 0
    plan = mixing.op10_mixing(spark, SF01)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mixing_given_targets(spark):
    docs = common.table(spark, SF01, "documents")
    want = spark.createDataFrame([("en", 3.0), ("de", 1.0)], "category string, share double")
    rows = mixing.weighed(docs, {"lang": want}, budget=0.1).collect()
    tokens = Counter()
    for r in rows:
        tokens[r.lang] += r.n_tokens * r.weight
    assert tokens["en"] / tokens["de"] == pytest.approx(3, rel=1e-4) and tokens["fr"] == 0


def test_mixing_drawn_marginals(spark):
    """Expected shares of the sample: near the targets where no budget forces more whole cells, and as marginals() says where one does."""
    docs = common.table(spark, SF01, "documents")
    raked = mixing.rake(mixing.cells_of(mixing.described(docs)), common.work_dir(spark, "t"))
    for budget in (None, 0.8):
        rows = mixing.weighed(docs, budget=budget).collect()
        said = {(r.dimension, r.category): r for r in mixing.marginals(mixing.calibrated(raked, budget)).collect()}
        drawn = sum(r.n_tokens * r.probability for r in rows)
        assert all(0 <= r.probability <= 1 for r in rows)
        for d in mixing.DIMENSIONS:
            natural, got = Counter(), Counter()
            for r in rows:
                natural[r[d]] += r.n_tokens
                got[r[d]] += r.n_tokens * r.probability / drawn
            whole = sum(x**mixing.POWER for x in natural.values())
            for k, x in natural.items():
                assert said[d, k].target == pytest.approx(x**mixing.POWER / whole, abs=1e-5)
                assert said[d, k].achieved == pytest.approx(got[k], abs=1e-5)
            assert budget or sum(abs(got[k] - said[d, k].target) for k in natural) / 2 <= mixing.MISS + 1e-9


def test_mixing_equals_plain_raking(spark):
    """Raking by loops over dictionaries, the largest factor of the grid by trying each, and the draw by hashlib."""
    rows = [(r.doc_id, r.source, r.lang, r.topic, r.n_tokens) for r in mixing.weighed(common.table(spark, SF01, "documents")).collect()]
    cells = Counter()
    for _, *cell, n in rows:
        cells[tuple(cell)] += n
    total = sum(cells.values())
    share = {c: n / total for c, n in cells.items() if n}
    natural = [Counter() for _ in range(3)]
    for c, x in share.items():
        for d in range(3):
            natural[d][c[d]] += x
    target = [{k: x**mixing.POWER / sum(y**mixing.POWER for y in m.values()) for k, x in m.items()} for m in natural]
    weight = dict(share)

    def marginal(values, d):
        out = Counter()
        for c, x in values.items():
            out[c[d]] += x
        return out

    for _ in range(400):
        for d in range(3):
            now = marginal(weight, d)
            weight = {c: x * target[d][c[d]] / now[c[d]] for c, x in weight.items()}
    ratio = {c: weight[c] / share[c] for c in share}
    low, high, best = min(ratio.values()), max(ratio.values()), None
    for k in range(mixing.FACTORS + 1):
        p = {c: min(1.0, (high / low) ** (k / mixing.FACTORS) / high * x) for c, x in ratio.items()}
        drawn = sum(share[c] * p[c] for c in p)
        if all(sum(abs(x / drawn - target[d][c]) for c, x in marginal({c: share[c] * p[c] for c in p}, d).items()) / 2 <= mixing.MISS for d in range(3)):
            best = p
    for r in mixing.op10_mixing(spark, SF01).collect():
        c = (r.source, r.lang, r.topic)
        assert r.weight == pytest.approx(ratio.get(c, 0), abs=1e-4) and r.probability == pytest.approx(best.get(c, 1), abs=1e-4)
        u = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        assert r.selected == (u < r.probability) or abs(u - r.probability) < 1e-4


def test_mixing_equals_sql(spark):
    got, want = compare(spark, duck(SF), SF, mixing.op10_mixing, mixing.SQL)
    assert got == want


def test_mixing_of_many_cells_and_contradictions(spark):
    """The form for many cells rakes alike; targets that contradict each other end with a warning and the last marginal met."""
    docs = common.table(spark, SF, "documents")
    cells = mixing.cells_of(mixing.described(docs))
    few = {tuple(r[d] for d in mixing.DIMENSIONS): r.weight for r in mixing.rake(cells, common.work_dir(spark, "t")).collect()}
    many = {tuple(r[d] for d in mixing.DIMENSIONS): r.weight for r in mixing.rake(cells, common.work_dir(spark, "t"), few=0).collect()}
    assert few.keys() == many.keys() and all(many[k] == pytest.approx(x, abs=1e-6) for k, x in few.items())
    odd = spark.createDataFrame([(1, "s1", "en", "a b"), (2, "s2", "de", "a b c"), (3, "s2", "fr", "a")], "doc_id long, source string, lang string, text string")
    with pytest.warns(UserWarning, match="did not converge"):
        rows = mixing.weighed(odd).collect()
    assert all(0 <= r.probability <= 1 for r in rows) and sum(r.n_tokens * r.weight for r in rows) / 6 == pytest.approx(1)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="<p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site.</div>
<aside class=side>Other things you may like to read today on the site</aside>
<article><header><h1>The title &amp; more</h1></header><p>This is the first paragraph of the article, and it is long enough to be decided by its words.</p>
<p>Short.</p><div class="advert">Buy it now, it is the best thing that there is for you and for me</div>
<form><label>Name</label><input></form><p class="x">The <b>second</b>&nbsp;paragraph is\n\n here and it&#39;s also part of the text that we want to keep for later.<br>After a break
<p>Unclosed one with the last words of it</article>
<section id="comments"><p>I think that this is a very good article and I agree with all of it, thank you.</p></section>
<footer>&copy; the site, all rights reserved</footer></body></html>"""


def test_extraction():
    want = "The title & more This is the first paragraph of the article, and it is long enough to be decided by its words. Short. The second paragraph is here and it's also part of the text that we want to keep for later. After a break Unclosed one with the last words of it"
    assert html_text.extract(PAGE) == want
    assert html_text.extract("") == "" and html_text.extract("<p") == "" and html_text.extract("<nav>a</nav><script>x") == ""
    plain = "<div><p>" + "This is one of the longer paragraphs that has the usual words in it. " * 4 + "</p><p>Yes.</p></div><ul><li><a href=x>Link one</a></li></ul>"
    assert html_text.extract(plain).endswith("words in it. Yes.")


def test_article_inside_named_wrappers():
    """A wrapper's name or a page-wide form does not lose the article; comments and asides stay out."""
    text = "This is the article, and it is long enough to be decided by the words that are in it."
    inner = f"<div class=sidebar><p>Other things that you may like to read on the site</p></div><article><p>{text}</p></article>"
    inner += "<section class=comments><article><p>I think that this is a very good article and I agree with all of it.</p></article></section>"
    for wrapper in ('div class="page has-sidebar"', 'div class="layout no-sidebar"', 'div id="content" class="with-comments"', "form id=aspnetForm", "div class='sidebar page'", "div class='comments-enabled'"):
        assert html_text.extract(f"<body><{wrapper}>{inner}</{wrapper.split()[0]}><footer>the end of it</footer></body>") == text
    plain = "<div><p>" + "This is one of the longer paragraphs that has the usual words in it. " * 4 + "</p></div>"
    for other in ("<div class=sidebar><article><p>Another text that is on the site and is of no use to this one at all.</p></article></div>", f"<div class=related><article><p>{text * 9}</p></article></div>"):
        assert html_text.extract(plain + other) == html_text.extract(plain) != ""


LONG = "This is the story that we want, and it is told at some length so that it can be seen for what it is. " * 4


@pytest.mark.parametrize(
    "page, want",
    [
        ("<body><div class='content no-sidebar'><p>{0}</p></div></body>", "{0}"),
        ("<body><article><p>{0}</p><section id='social-history'><p>{0}</p></section></article></body>", "{0} {0}"),
        ("<body><article><p>{0}</p><div class='social-share'><p>{0}</p></div></article></body>", "{0}"),
        ("<body><form id=aspnetForm><div><p>{0}</p></div></form></body>", "{0}"),
        ("<body><div class='page sidebar'><div><p>{0}</p></div></div><footer>The end of it</footer></body>", "{0}"),
        ("<article><p>A short teaser of it.</p></article><div class=story><p>{0}</p><p>{0}</p></div>", "A short teaser of it. {0} {0}"),
        ("<div><p title=\"a>{0}</p><p>{0}</p></div>", "{0} {0}"),
        ("<div><script>var x = '</scripts>'; no text</script><p>{0}</p></div>", "{0}"),
        ("<div><a href=/x/>Home is where this link goes, and it is long enough to be a text of its own as to length</a><p>{0}</p></div>", "{0}"),
        ("<div><a name=top /><p>{0}</p></div>", "{0}"),
        ("<div><p class=it's>{0}</p><p>{0} It's.</p></div>", "{0} {0} It's."),
        ("<div role=main><p>Short one.</p><p>{0}</p></div><div><p>{0}</p></div>", "Short one. {0}"),
        ("<div class='related-posts'><p>{0}</p></div><div class='sidebar-left'><p>{0}</p></div><div class=post><p>{0}</p></div>", "{0}"),
    ],
)
def test_extraction_of_shapes(page, want):
    """Shapes that lost the article or kept what is not of it; expected texts by hand."""
    text = LONG.strip()
    assert html_text.extract(page.format(text)) == want.format(text)


@pytest.mark.parametrize(
    "text",
    [
        "北京今天举行了一次重要的会议。与会者讨论了经济问题和环境保护的措施。会议持续了三个小时，最后通过了一项决议。" * 3,
        "Сегодня в городе прошла большая встреча жителей. Участники говорили о дорогах и школах. Решение примут осенью. " * 3,
        "Oggi in città la gente parla molto della nuova legge sulle strade. Il sindaco dice che serve tempo. Vedremo cosa succede domani. " * 3,
        "Kaupungin asukkaat kokoontuivat tänään puhumaan uusista teistä. Pormestari sanoi asian vievän aikaa. Päätös tehdään syksyllä kokouksessa. " * 3,
    ],
)
def test_extraction_of_other_languages(text):
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Menu entry number {i}</a></li>" for i in range(9)) + "</ul>"
    table = "<div>" + "AX-100 12,5 kg 99 € AX-200 13,5 kg 109 € AX-300 14,5 kg 119 € " * 5 + "</div>"
    assert html_text.extract(f"<body>{menu}<div class=story><p>{text}</p></div>{menu}</body>") == text.strip()
    assert html_text.extract(f"<body>{menu}{table}</body>") == ""


def test_extraction_of_tables(spark):
    rows = {r.page_id: r for r in html_text.op3_html_text(spark, SF01).collect()}
    for p in common.table(spark, SF01, "pages").collect():
        body = re.search(r"<article>(.*?)(</article>|<footer|$)", p.html, re.S)[1]
        want = re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", body)))).strip()
        assert (rows[p.page_id].text, rows[p.page_id].n_chars, rows[p.page_id].url) == (want, len(want), p.url)
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "<b>x" * 50_000, 3), (1, "u", "<b>x" * 50_000, 3)], "page_id long, url string, html string, text int")
    assert html_text.extracted(odd).count() == 4 and html_text.extracted(odd.limit(0)).count() == 0


def test_hostile_pages_take_linear_time():
    many = 60_000
    for page in ("<a" * many, "<a '\"" * many, "<!x" * many, "<b>" * many + "x</i>" * many, "<a>" * many + "x</a>" * many):
        began = time.time()
        html_text.extract(page)
        assert time.time() - began < 20


def test_toxic_word_beginnings_reach_unseen_words():
    """Texts are toxic by a word of one beginning and ever new endings; single words say nothing."""
    texts = [f"filler{i} word{i % 7} {'grumbl' if i % 3 == 0 else 'kindly'}{i}x" for i in range(600)]
    y = np.array([int(i % 3 == 0) for i in range(600)])
    doc, term = toxicity.features(texts)
    assert set(zip(doc.tolist(), term.tolist(), strict=True)) == {(d, t) for i, text in enumerate(texts) for d, t in ((i, t) for t in toxicity.features([text])[1].tolist())}
    model = toxicity.fit(doc, term, y)
    p = 1 - model.grades(model.strength(["unseen grumblzzz", "unseen kindlyzzz", ""]))[:, 0]
    assert p[0] > 0.5 > p[1] and p[2] < 0.5
    assert toxicity.fit(*toxicity.features(["", " "]), np.array([0, 1])) is None


def test_stages_leave_other_columns_as_they_are(spark, odd_docs):
    """Whatever names they have, those that the operators use inside included."""
    names = ["_kept", "_bad", "_tokens", "_source", "_p", "_row", "node", "k"]
    odd = odd_docs.withColumns({n: F.lit(n) for n in names})
    rows = Counter(map(repr, odd.collect()))
    labels, bench = common.table(spark, SF01, "labels"), common.table(spark, SF01, "benchmark")
    for kept in (quality.keep_good(odd, labels), simhash.keep_one(odd), near_dups.keep_one(odd), decontam.keep_clean(odd, bench), mixing.keep_selected(odd)):
        assert kept.columns == odd.columns and not Counter(map(repr, kept.collect())) - rows


def test_pipeline_stages(spark):
    """Each stage does to its own input what its operator says, and the last table covers what is left."""
    docs = common.table(spark, SF01, "documents")
    columns, folder = docs.columns, common.work_dir(spark, "stages")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.saved(stage(spark, docs, SF01), f"{folder}/{n}")
        before, after = docs.count(), out.count()
        if name == "near_dedup":
            classes = near_dups.classes(docs).agg(F.countDistinct("component_id").alias("n")).first().n
            assert after == classes
        if name == "tokens":
            assert after == before and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        else:
            assert 0 < after < before and out.columns == columns
            docs = out
    assert len(corpus_pipeline.STAGES) == 5
