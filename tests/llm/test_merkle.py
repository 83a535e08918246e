"""The manifest against a plain tree in memory."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordersight.llm import merkle as M

LOWER = {c: c + 32 for c in range(65, 91)}


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, fanout):
    """The root, and of each node the siblings on each level with its own place."""
    at, proof = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, a in enumerate(at):
            first = a - a % fanout
            proof[k].append((a - first, [x for i, x in enumerate(nodes[first:first + fanout]) if i != a - first]))
            at[k] = a // fanout
        nodes = [H(*nodes[k:k + fanout]) for k in range(0, len(nodes), fanout)]
    return nodes[0], proof


def brute(rows, tampered, fanout=16):
    trees = {}
    for doc_id, source, lang, n, text in rows:
        leaf = H(*map(field, (doc_id, source, lang, n, text)))
        now = H(*map(field, (doc_id, source, lang, n, text and text.translate(LOWER)))) if tampered(doc_id) else leaf
        trees.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, doc_id, now))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    done = {}
    for s in names:
        own = sorted(trees[s], key=lambda x: x[:3])
        done[s] = own, climb([x[2] for x in own], fanout)
    root, above = climb([done[s][1][0] for s in names], fanout)
    out = []
    for s, up in zip(names, above, strict=True):
        own, (sub, proofs) = done[s]
        for (*_, leaf, doc_id, now), low in zip(own, proofs, strict=True):
            folded = now
            for a, others in low + up:
                folded = H(*others[:a], folded, *others[a:])
            out.append((doc_id, leaf, sub, root, H(*(x for _, o in low + up for x in o)), folded, folded == root))
    return sorted(out, key=repr)


def by_crc(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows],
                               "doc_id long, source string, lang string, n_chars long, text string, digest string, p int")
    got = M.manifest(df, tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, **options).collect()
    return sorted((tuple(r) for r in got), key=repr)


@pytest.mark.parametrize("fanout", [2, 3])
@pytest.mark.parametrize("sizes", [(1, 2, 9, 70, 203), (64,), (65, 1), (17, 28, 8)])
def test_butterfly_equals_plain_trees(spark, fanout, sizes):
    """Small fanouts, so that trees of many partitions and short last groups on every level appear."""
    rows = [(1000 * s + k, f"s{s}", "en", k, f"Text {k} OF {s}") for s, n in enumerate(sizes) for k in range(n)]
    assert found(spark, rows, fanout=fanout) == brute(rows, by_crc, fanout)


def test_odd_rows(spark):
    rows = [(k, "+", None, None, None) for k in range(3)] + [(k, None, "", 0, "") for k in range(40)]
    rows += [(5, "é", "de", 1, "A")] * 20 + [(None, "", "-", 3, "Z"), (None, "", "-", 3, "Z"), (None, "", "-", 3, "Y")]
    rows += [(7, "z", "en", 9, "Long TEXT " * 30_000), (8, "\U0001f600", "en", 9, "É A"), (9, "￿", "en", 9, "a")]
    assert found(spark, rows) == brute(rows, by_crc)
    assert found(spark, []) == []
    assert found(spark, rows[:1]) == brute(rows[:1], by_crc)


def test_many_sources(spark):
    r = np.random.default_rng(4)
    rows = [(k, f"host{r.integers(0, 300)}", "en", k, "T" * int(r.integers(0, 5))) for k in range(900)]
    assert found(spark, rows, fanout=4) == brute(rows, by_crc, 4)


def test_query_equals_brute_force(spark):
    from ordersight.llm.queries import op13_merkle
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op13_merkle(spark, sf)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, by_crc)
