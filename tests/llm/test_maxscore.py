"""Exact top-k search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordersight.llm import maxscore as M


def brute(rows, asks, k, scale=64):
    """``(query_id, rank, vec_id, score)`` over all other rows; shorter vectors are filled up with 0."""
    own = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    own = [(i, [math.floor(scale * x) for x in v]) for i, v in own]
    out = []
    for a, (i, x) in enumerate(own):
        if i is not None and asks(i):
            scores = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), j is not None, j or 0)
                            for b, (j, y) in enumerate(own) if b != a)
            out += [(i, r, j if named else None, -s) for r, (s, named, j) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def table(n, size, r, zeros=0.0):
    v = r.normal(size=(n, size)) / math.sqrt(size)
    v[r.random((n, size)) < zeros] = 0
    return [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]


def found(df, **options):
    rows = M.search(df, F.col("vec_id") % 20 == 0, **options).collect()
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in rows), key=repr)


@pytest.mark.parametrize("n, size, zeros, shard_rows", [(700, 16, 0.0, 64), (400, 40, 0.8, 8192)])
def test_equals_brute_force(spark, n, size, zeros, shard_rows):
    rows = table(n, size, np.random.default_rng(n), zeros)
    rows += [(n + k, rows[5][1]) for k in range(60)]  # many ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, shard_rows=shard_rows, block_rows=9) == brute(rows, lambda i: i % 20 == 0, 20)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (20, [0.5, None]), (40, None), (60, [nan, 1.0]), (80, [inf, 0.0]), (100, []), (1, [0.1]),
            (2, [-0.5, -0.5, 9.0]), (0, [0.5, -0.25]), (None, [1.0, 1.0]), (None, [1.0, 1.0]), (120, [0.0, 0.0]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "s", 0) for i, v in rows],
                               "vec_id long, embedding array<double>, score int, shard string, query int")
    for options in ({}, {"shard_rows": 2, "block_rows": 1}, {"k": 2, "shard_rows": 3}):
        assert found(df, **options) == brute(rows, lambda i: i % 20 == 0, options.get("k", 20))
    assert found(df.limit(0)) == [] and found(df.limit(1)) == []
    with pytest.raises(Exception, match="32 bits"):
        found(spark.createDataFrame([(0, [1e9])], "vec_id long, embedding array<double>"))


def test_bounds_spare_candidates():
    """With a clear threshold most terms are non-essential, and few candidates are probed."""
    r = np.random.default_rng(3)
    v = np.where(r.random((2000, 300)) < 0.03, r.integers(1, 40, (2000, 300)), 0)
    shard = M.Shard(list(v), np.arange(2000), 40)
    got, score = shard.search(v[7], 7, 5)
    exact = v @ v[7]
    exact[7] = -1
    want = np.lexsort((np.arange(2000), -exact))[:5]
    assert got.tolist() == want.tolist() and score.tolist() == exact[want].tolist()
    assert shard.search(v[7], 7, 5, floor=int(exact.max()) + 1)[0].tolist() == []


def test_query_equals_brute_force(spark):
    from ordersight.llm.queries import op11_maxscore
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in op11_maxscore(spark, sf).collect()), key=repr)
    assert got == brute(rows, lambda i: i % 20 == 0, 20)
