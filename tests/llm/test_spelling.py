"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ordersight.llm import spelling as S

LOWER = {c: c + 32 for c in range(65, 91)}


def one_edit(a, b):
    """Whether one code point inserted, deleted or replaced makes a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(docs, length=5, count=3):
    n = Counter()
    for doc_id, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= length and k >= count}
    by_cut = {}
    for w in n:  # near words share the word with one code point left out, or are it
        for x in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))}:
            by_cut.setdefault(x, []).append(w)
    near = {w: {b for x in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))} for b in by_cut[x] if one_edit(w, b)} for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return out


def rows(df):
    got = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_tiles_equal_the_definition():
    r = np.random.default_rng(1)
    pool = sorted({"".join(r.choice(list("abà"), int(r.integers(4, 8)))) for _ in range(300)})
    for short in (4, 5, 6):
        some = [w for w in pool if len(w) in (short, short + 1)]
        own = [w.encode("latin-1") for w in some] + [b"", b""]
        for end in (False, True):
            got = S.near([own], [own], short, end)[0]
            for i, a in enumerate(some):
                for j, b in enumerate(some):
                    front = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
                    want = one_edit(a, b) and min(len(a), len(b)) == short and not (end and front >= short // 2)
                    assert got[i, j] == want, (a, b, end)
            assert not got[-2:].any() and not got[:, -2:].any()


@pytest.mark.parametrize("block", [512, 7])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "_BLOCK", block)
    monkeypatch.setattr(S, "_CELLS", 1 << 10)
    r = np.random.default_rng(2)
    pool = ["".join(r.choice(list("abcé"), int(r.integers(4, 8)))) for _ in range(400)]
    docs = [(k, " ".join(r.choice(pool, 60, p=None))) for k in range(60)]
    docs += [(100 + k, "separate Separate separate seperate separat sépärate ÀÉÎõü÷×") for k in range(9)]
    docs += [(None, "separate"), (5, None), (6, ""), (7, "a" * 60_000), (7, "a" * 59_999 + "b"), (8, ("b" + "a" * 59_999 + " ") * 3),
             (9, ("a" * 60_000 + " ") * 5), (1, docs[1][1]), (1, docs[1][1])]
    df = spark.createDataFrame([(d, t, 1, "w") for d, t in docs], "doc_id long, text string, n int, word string")
    got = rows(S.variants(df))
    assert got == brute(docs)
    assert any(root != form and form for *_, form, _, root in got)  # a chain


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.variants(df).count() == 0


def test_query_equals_brute_force(spark):
    from ordersight.llm.queries import op12_spelling
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(op12_spelling(spark, sf)) == brute(docs)
