"""The recurrent model: gradient, windows and lanes against plain loops, scores against brute force, held-out gain."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from ordersight.llm import gru as G
from ordersight.llm import lm as L


def first(seed=3):
    r = np.random.default_rng(seed)
    share = np.full(G.CLASSES + G.BUCKETS, 1.0 / (G.CLASSES + G.BUCKETS))
    flat = G.start(G.WORDS, share, np.full(G.WORDS, 1.0 / G.MEMBERS))
    return flat + 0.3 * r.normal(size=G.SIZE).astype(np.float32)


def plain(flat, doc):
    """Log-likelihood of one document, token by token, in double precision."""
    p = {k: v.astype(float) for k, v in G.views(flat).items()}
    h, x, total, k = np.zeros(G.HIDDEN), G.START, 0.0, 2 * G.HIDDEN
    for y in doc:
        a, xt = h @ p["u"], p["wx"][x] + p["bx"]
        s = 1 / (1 + np.exp(-(xt[:k] + a[:k])))
        m = np.tanh(xt[k:] + s[G.HIDDEN:] * a[k:])
        h = (1 - s[:G.HIDDEN]) * m + s[:G.HIDDEN] * h
        c = y // G.MEMBERS if y < G.WORDS else y - G.WORDS + G.CLASSES
        v = h @ p["wc"] + p["bc"]
        total += v[c] - np.log(np.exp(v).sum())
        if y < G.WORDS:
            v = h @ p["ws"][c] + p["bs"][c]
            total += v[y % G.MEMBERS] - np.log(np.exp(v).sum())
        x = y
    return total


def some_docs(n=9, seed=4):
    r = np.random.default_rng(seed)
    return [r.integers(0, G.START, int(k)).astype(np.int32) for k in r.integers(1, 90, n)]


@pytest.mark.parametrize("width", [1, 4, 64])
def test_state_is_carried_over_windows_and_lanes(width):
    flat, docs = first(), some_docs()
    want = [plain(flat, d) for d in docs]
    assert G.log_likelihood(flat, docs, window=7, width=width) == pytest.approx(want, rel=1e-4)


def test_gradient_equals_differences():
    flat, docs = first(), some_docs(6)
    x, y, owner, _ = G.streams(docs, 3)
    h = np.zeros((G.HIDDEN, x.shape[1]), dtype=np.float32)
    x, y, real = x[:8], y[:8], owner[:8] >= 0
    _, grad, _ = G.gradient(flat, x, y, real, h)

    def loss(f):
        p = {k: v for k, v in G.views(f).items()}
        return G.gradient(f.astype(np.float32), x, y, real, h)[0] if p else 0
    at = 0
    for name, shape in G._SHAPES.items():
        n = int(np.prod(shape))
        for i in at + np.argsort(-np.abs(grad[at:at + n]))[:3]:
            up, down = flat.copy(), flat.copy()
            up[i] += 1e-2
            down[i] -= 1e-2
            assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(grad[i], rel=0.05, abs=2e-4), name
        at += n


def test_training_lowers_held_out_loss():
    r = np.random.default_rng(6)
    docs = []
    for _ in range(300):  # two languages, and words that follow each other
        base = 100 * int(r.integers(0, 2))
        d, k = [], int(r.integers(0, 20))
        for _ in range(60):
            k = (k + 1) % 20 if r.random() < 0.8 else int(r.integers(0, 20))
            d.append(base + k)
        docs.append(np.array(d, dtype=np.int32))
    flat = first() * 0.3
    before = G.log_likelihood(flat, docs[200:]).sum()
    square = np.full(G.SIZE, 1e-4, dtype=np.float32)
    for _ in range(4):
        flat, square = G.train(flat, square, docs[:200], width=16)
    assert G.log_likelihood(flat, docs[200:]).sum() > 0.6 * before


def test_a_long_document_is_trained_with_one_state():
    """The start state comes once a document, however many windows it takes."""
    starts, plain_gradient = [], G.gradient

    def watch(flat, x, y, real, h):
        starts.append((x == G.START).sum())
        return plain_gradient(flat, x, y, real, h)
    G.gradient = watch
    try:
        G.train(first(), np.full(G.SIZE, 1e-4, dtype=np.float32), [np.arange(2500, dtype=np.int32) % G.WORDS], width=4)
    finally:
        G.gradient = plain_gradient
    assert sum(starts) == 1 and starts[0] == 1


def test_a_step_works_only_on_parameters_of_its_tokens():
    """Equal to a step over all parameters, without touching those of other tokens."""
    flat, docs = first(), some_docs(6)
    x, y, owner, _ = G.streams([d[d < 300] for d in docs], 3)
    _, grad, _ = G.gradient(flat, x, y, owner >= 0, np.zeros((G.HIDDEN, x.shape[1]), dtype=np.float32))
    want, total = flat.copy(), np.full(G.SIZE, 1e-4, dtype=np.float32)
    g = grad / max(1.0, float(np.sqrt((grad * grad).sum())))
    total += g * g
    want -= 0.1 * g / np.sqrt(total)

    class Watched(np.ndarray):
        """Notes how many values each assignment puts in."""
        put = 0

        def __setitem__(self, key, value):
            Watched.put += np.asarray(self[key]).size
            super().__setitem__(key, value)
    got, square = flat.copy().view(Watched), np.full(G.SIZE, 1e-4, dtype=np.float32)
    G._step(got, square, grad, x, y, 1.0, 0.1)
    assert np.allclose(got, want, atol=1e-6) and np.allclose(square, total, rtol=1e-5)
    assert 0 < Watched.put < G.SIZE / 4


@pytest.mark.parametrize("scale", [1, 20])
def test_scores_hold_for_logits_of_any_size(scale):
    """With small logits no maximum is taken off; large ones need it."""
    flat, docs = first(), some_docs()
    p = G.views(flat)
    for name in ("wc", "bc", "ws", "bs"):
        p[name] *= scale
    assert G._tame(p["wc"], p["bc"]) == (scale == 1)
    got = G.log_likelihood(flat, docs, window=7, width=4)
    assert got == pytest.approx([plain(flat, d) for d in docs], rel=1e-3)


def test_a_window_without_words_of_its_own():
    flat, docs = first(), [np.array([G.WORDS + 3, G.WORDS, G.WORDS + 3], dtype=np.int32)]
    assert G.log_likelihood(flat, docs) == pytest.approx([plain(flat, d) for d in docs], rel=1e-4)
    x, y, owner, _ = G.streams(docs, 1)
    loss, grad, _ = G.gradient(flat, x, y, owner >= 0, np.zeros((G.HIDDEN, 1), dtype=np.float32))
    assert loss == pytest.approx(-plain(flat, docs[0]) / 3, rel=1e-4) and not G.views(grad)["ws"].any()


def test_windows_reuse_the_memory_of_the_last():
    """Arrays freed after a window are not given back to the system, to be made page by page for the next one."""
    resource = pytest.importorskip("resource")
    docs = [np.arange(2000, dtype=np.int32) % G.START for _ in range(256)]
    faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    x, y, owner = next(G.Streams(docs, 256).windows(16))
    flat, square = first(), np.full(G.SIZE, 1e-4, dtype=np.float32)
    G.train(flat, square, [d[:64] for d in docs])
    h, before = np.zeros((G.HIDDEN, 256), dtype=np.float32), faults()
    for _ in range(10):
        G.gradient(flat, x, y, owner >= 0, h)
    assert faults() - before < 10 * 500


def test_the_model_has_a_thousand_words_of_its_own():
    assert G.WORDS >= 1024 and G.HIDDEN >= 16 and G.BUCKETS >= 32


def brute(docs):
    """doc -> (held_out, n_tokens, n_known, N, base score) and the word counts."""
    split = {k: (zlib.crc32(str(d).encode()) % 5 == 1 if d is not None else False,
                 (t or "").encode().lower().split() + [L.END]) for k, (d, t) in enumerate(docs)}
    c = Counter(w for out, words in split.values() if not out for w in words)
    n, v = sum(c.values()), len(c)
    return {k: (out, len(words), sum(c[w] > 0 for w in words), n,
                sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)) for k, (out, words) in split.items()}, c


def compare(rows, docs):
    want, _ = brute(docs)
    key = lambda x: repr(x[:5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=key)
    exp = sorted(((docs[k][0], *w) for k, w in want.items()), key=key)
    assert [g[:5] for g in got] == [e[:5] for e in exp]
    assert [g[5] for g in got] == pytest.approx([e[5] for e in exp], rel=1e-9)


DOCS = [(i, " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(40))) for i in range(60)] + [
    (100, None), (101, ""), (None, "W1 w2 ñ"), (7, "unseen words here"), (103, "x " * 30_000),
    (104, "same text"), (104, "same text"), (105, "É é\tA\x0bB C")]


@pytest.mark.parametrize("head", [200_000, 50])
def test_scores_of_a_small_table(spark, head):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in DOCS], "doc_id long, text string, word string, n int")
    rows = L.score(df, head=head).collect()
    compare(rows, DOCS)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_score_is_a_distribution_over_words(spark):
    """The probabilities of all known words and of one unseen word in each bucket add up to one."""
    docs = [(10, " ".join(f"v{k}" for k in range(1500)) + " v1 v2 v2")]
    _, c = brute(docs)
    words = [w.decode() for w in c if w != L.END]
    unseen, k = {}, 0
    while len(unseen) < G.BUCKETS:
        k += 1
        unseen.setdefault(L.bucket(f"q{k}".encode()), f"q{k}")
    held = [i for i in range(100_000) if zlib.crc32(str(i).encode()) % 5 == 1][:len(words) + len(unseen) + 1]
    more = [(i, t) for i, t in zip(held, [*words, *unseen.values(), ""], strict=True)]
    rows = {r.doc_id: r for r in L.score(spark.createDataFrame(docs + more, "doc_id long, text string")).collect()}
    # P(word) P(end | word) over all words, and P(end): summed with P(end | word) taken out by a bound
    total = sum(10 ** r.score for d, r in rows.items() if d != 10)
    assert 0 < total < 1


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.score(df).count() == 0
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = L.score(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.base_score == pytest.approx(0)


def test_query_equals_brute_force_and_beats_the_base(spark):
    from ordersight.llm.queries import op4_lm
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op4_lm(spark, sf).collect()
    compare(rows, docs)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
