"""Near-duplicates and components against brute force."""

import numpy as np
import pytest

from ordersight.llm import minhash as M
from ordersight.llm.components import components


def shingle_set(text, width=5):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    n = min(width, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def brute(docs):
    """component of each id: union of all pairs at 0.75 or more."""
    sets = [(d, shingle_set(t)) for d, t in docs if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1:]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in parent}


def mutate(words, share, r):
    out = list(words)
    for k in r.choice(len(out), int(len(out) * share), replace=False):
        out[k] = f"x{r.integers(0, 10**9)}"
    return out


def corpus():
    """Groups of near copies whose centre is not the smallest id, chains, exact copies and odd rows."""
    r = np.random.default_rng(5)
    docs, next_id = [], 1000
    for g in range(6):
        base = [f"g{g}w{r.integers(0, 5000)}" for _ in range(200)]
        docs.append((next_id + 900, " ".join(base)))
        for k in range(12):
            docs.append((next_id + k, " ".join(mutate(base, (0.01, 0.025, 0.04)[k % 3], r))))
        next_id += 1000
    chain = [f"c{i}" for i in range(400)]
    docs += [(50 + i, " ".join(chain[i * 10:i * 10 + 120])) for i in range(20)]
    docs += [(i, "short text") for i in (7, 8, 9)] + [(10, "Short  TEXT"), (11, "text short"), (12, None), (13, ""), (14, " \n")]
    docs += [(20, "a b c d e"), (20, "a b c d e"), (21, "A B C D E"), (None, "a b c d e"), (22, "a b c d e f g h i j " * 3000)]
    return docs


def test_all_links_found(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, n int, key string")
    rows = M.near_duplicates(df).collect()
    assert len(rows) == len(docs)
    want = brute(docs)
    got = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert got == want
    size = {d: len(shingle_set(t)) for d, t in docs}
    assert all(r.n_shingles == size[r.doc_id] for r in rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    left = M.deduplicate(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted([-1, *set(want.values())])


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = np.unique(x[:3500]), np.unique(x[500:])
    s = M.signatures([a, b])
    assert abs((s[0] == s[1]).mean() - 3000 / 4000) < 0.12
    assert sorted(M._ORDER) == list(range(2 * M.PERMS))


@pytest.mark.parametrize("others", [0, 3])
def test_low_bytes_that_agree_by_chance_share_no_bucket(spark, others):
    """Band 0 of members 1 and 2 agrees in the low bytes only, in larger buckets of others; band 5 is their bucket."""
    sig = np.arange(2 * M.PERMS, dtype=np.uint8)
    rows = []
    for rep in (1, 2, *range(10, 10 + others)):
        keys, sizes = np.zeros(M.BANDS, dtype=">i8"), np.zeros(M.BANDS, dtype=">i4")
        keys[0], sizes[0] = 1000 + rep, 50
        keys[5], sizes[5] = -77, 2 + others
        own = sig if rep < 10 else (sig + rep).astype(np.uint8)  # the others agree with nobody
        rows.append((-77, 0, 0, rep, rep, 100, 0, 5, own.tobytes(), keys.tobytes(), sizes.tobytes()))
    spread = spark.createDataFrame(rows, "key long, i long, j long, rep long, comp long, n long, blk long, band int, "
                                         "sig8 binary, keys binary, sizes binary")
    assert sorted((r.key, r.rep) for r in M._maybe(spread, 75).collect()) == [(-77, 1), (-77, 2)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert M.near_duplicates(df).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_components_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (150, 2))] + [(i, i + 1) for i in range(400, 470)] \
        + [(1000, k) for k in range(1001, 1100)] + [(None, 3), (5, 5)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)


def test_query_equals_brute_force(spark):
    from ordersight.llm.queries import op5_minhash
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    rows = op5_minhash(spark, sf).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id: r.n_shingles for r in rows} == {d: len(shingle_set(t)) for d, t in docs}


def brute_by_id(docs):
    """Component of each id that may have several texts: an id is one document with all their links."""
    sets = [(d, shingle_set(t)) for d, t in docs if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1:]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in parent}


def test_ids_with_several_texts(spark):
    """The smallest id of several classes, ids with two and three texts, null ids and empty texts among them."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    docs = [(1, a), (2, a + " more"), (1, b), (3, b + " more"), (1, c), (4, c), (1, None), (1, ""),
            (7, a[:200] + " other"), (8, "one two three four five"), (8, "six seven eight nine ten"),
            (9, "six seven eight nine ten"), (10, "one two three four five"), (8, "six seven eight nine ten"),
            (None, a), (None, a), (None, None), (11, None), (12, "alone in the world it is")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = M.near_duplicates(df).collect()
    assert len(rows) == len(docs)
    want = brute_by_id(docs)
    assert {(r.doc_id, r.component_id) for r in rows if r.doc_id is not None} == set(want.items())
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    left = M.deduplicate(df).collect()
    assert sorted(r.doc_id for r in left if r.text and r.doc_id) == sorted({find for d, find in want.items() if d != 11})
    assert sum(r.doc_id is None for r in left) == 3 and sum(not r.text for r in left) == 4


def test_codes_take_little_memory():
    """Numbers stand for the same values in all sets; not several arrays of all values at 64 bits are made for them."""
    import tracemalloc
    r = np.random.default_rng(3)
    own = [np.unique(r.integers(0, 400_000, 500, dtype=np.uint64)) * np.uint64(1 << 40) for _ in range(2000)]
    sets, size = [x.tobytes() for x in own], sum(x.nbytes for x in own)
    values = np.unique(np.concatenate(own))
    tracemalloc.start()
    codes, total = M._codes(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * size and not any(sets)
    assert total == len(values) and all((values[c] == x).all() for c, x in zip(codes, own, strict=True))


def test_wide_rows_pass_in_small_batches(spark, monkeypatch):
    """Texts and sets of several KB go to the workers few at a time, and the session's setting is as before."""
    key, seen, real = "spark.sql.execution.arrow.maxRecordsPerBatch", [], M.materialize
    before = spark.conf.get(key)
    monkeypatch.setattr(M, "materialize", lambda df, name: (seen.append(int(spark.conf.get(key))), real(df, name))[1])
    docs = spark.createDataFrame([(k, f"a b c d e f g {k % 3}") for k in range(20)], "doc_id long, text string")
    M.links(docs)
    assert seen and max(seen) <= 500 and spark.conf.get(key) == before


def test_reserved_memory_goes_back(monkeypatch):
    """Batches end with Arrow's reserve released, also where the reader stops early."""
    from ordersight.llm import common as C

    class Pool:
        freed = 0

        def release_unused(self):
            self.freed += 1

    pool = Pool()
    monkeypatch.setattr(C.pa, "default_memory_pool", lambda: pool)
    assert list(C.releasing(iter([1, 2]))) == [1, 2] and pool.freed == 1
    some = C.releasing(iter([1, 2]))
    next(some)
    some.close()
    assert pool.freed == 2
