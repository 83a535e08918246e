"""Exact top-k search by inner product, with MaxScore over sharded postings.

A component of a vector is a term with an integer weight (``scale`` times the
component, rounded down). Each shard of candidates keeps two postings a term, of
its positive and of its negative weights; a query walks the one in which its own
weight gives positive products.

1. *Bounds*: the best product a term can give in the shard, at least 0. Seeds
   (the heads of the strongest term's posting) and the scores of earlier shards
   give a threshold that the ``k``-th best score reaches.
2. *Split*: the weakest terms whose bounds together stay under the threshold are
   non-essential; a candidate in no essential posting cannot reach it.
3. *Traverse and probe*: the essential postings are added up; candidates that
   the other bounds can still lift to the threshold get their exact essential
   score, then the non-essential terms, strongest first, a few at a time, while
   they stay competitive.
4. *Merge*: shards are searched in rounds that grow eightfold. After each round
   the best ``k`` of each query are kept, and their least score goes into the
   next round, so that a shard returns few rows that do not last.

Queries go against all candidates in blocks: a task has one shard and one block
of queries, both of a fixed number of rows.

Defined cases: a vector that is null, or holds null or a non-finite number,
takes no part; an empty one scores 0 with all. Components that a shorter vector
lacks count 0. Every row is a candidate of its own, and a query's own row is
none of its candidates, but other rows with its id are; ties go to the smaller
id, null ids first. A weight of 2^31 or more, or scores that may not fit a
long, raise an error. An empty table gives no rows. Columns other than the id
and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_rows

_GROWTH, _TASKS = 8, 20_000
_STEP = 8


def weights(df: DataFrame, is_query: Column, *, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``vec_id, query, most, v``: the weights, as little-endian 32-bit bytes, of vectors that take part, and the greatest."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("query"),
                     F.col(f"`{vec_col}`").cast("array<double>").alias("v")).where("v is not null")

    def run(it):
        for batch in it:
            vec = batch.column(2)
            flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(vec.value_lengths().to_numpy())
            bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
            with np.errstate(invalid="ignore"):
                whole = np.floor(scale * flat)
            ids, asked = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, (a, b) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)):
                if bad[a] == bad[b]:
                    if np.abs(whole[a:b]).max(initial=0) >= 2**31:
                        raise ValueError(f"a weight of vector {ids[k]} needs more than 32 bits")
                    yield ids[k], asked[k], int(np.abs(whole[a:b]).max(initial=0)), whole[a:b].astype("<i4").tobytes()

    return map_rows(rows, run, [("vec_id", pa.int64(), "long"), ("query", pa.bool_(), "boolean"),
                                ("most", pa.int64(), "long"), ("v", pa.binary(), "binary")])


class Shard:
    """Postings of some candidates, given in the order in which ties go."""

    def __init__(self, vectors: list[np.ndarray], rows: np.ndarray, widest: int):
        size = max(map(len, vectors))
        most = max((int(np.abs(v.astype(np.int64)).max()) for v in vectors if len(v)), default=0)
        if size * most * widest >= 2**62:
            raise ValueError("scores may not fit a long")
        # doubles are exact here, and quicker to multiply
        self.weights = np.zeros((size, len(vectors)), dtype=np.float64 if size * most * widest < 2**53 else np.int64)
        for k, v in enumerate(vectors):
            self.weights[:len(v), k] = v
        self.rows = rows
        self.postings = []
        for w in self.weights:
            order = np.argsort(w, kind="stable")
            low, high = int((w < 0).sum()), int((w > 0).sum())
            down, up = order[:low], order[len(w) - high:][::-1]  # strongest first
            self.postings.append(((down, w[down]), (up, w[up])))
        self.best = np.array([[-a[1][0] if len(a[1]) else 0, b[1][0] if len(b[1]) else 0] for a, b in self.postings],
                             dtype=self.weights.dtype).reshape(size, 2)

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the best ``k`` candidates with at least ``floor``, best first."""
        size, n = self.weights.shape
        q = np.zeros(size, dtype=self.weights.dtype)
        q[:min(size, len(query))] = query[:size]
        sign = (q > 0).astype(int)
        bound = np.abs(q) * self.best[np.arange(size), sign]
        terms = np.flatnonzero(q)
        terms = terms[np.argsort(bound[terms], kind="stable")]
        theta = floor
        if len(terms):
            seeds = self.postings[terms[-1]][sign[terms[-1]]][0][:5 * k]
            got = np.sort((q @ self.weights[:, seeds])[self.rows[seeds] != own])
            if len(got) >= k and (theta is None or got[-k] > theta):
                theta = got[-k]

        upto = np.cumsum(bound[terms])
        if theta is None or theta <= 0 or not len(terms):  # a candidate in no posting may do
            some, score, rest, left = np.arange(n), q @ self.weights, 0, terms[:0]
        else:
            cut = int(np.searchsorted(upto, theta))
            essential, left, rest = terms[cut:], terms[:cut], upto[cut - 1] if cut else 0
            total = np.zeros(n, dtype=self.weights.dtype)
            for t in essential:
                docs, w = self.postings[t][sign[t]]
                total[docs] += q[t] * w
            some = np.flatnonzero(total + rest >= theta)
            score = q[essential] @ self.weights[np.ix_(essential, some)]
        while True:
            if theta is not None:
                keep = score + rest >= theta
                some, score = some[keep], score[keep]
            if not len(left):
                break
            part, left = left[-_STEP:], left[:-_STEP]
            score = score + q[part] @ self.weights[np.ix_(part, some)]
            rest = upto[len(left) - 1] if len(left) else 0
        other = self.rows[some] != own
        some, score = some[other], score[other]
        order = np.lexsort((some, -score))[:k]
        return some[order], score[order].astype(np.int64)


def _tasks(it) -> Iterator[tuple[list[tuple], Iterator[tuple]]]:
    """Of each run of equal (shard, block): the candidates, and an iterator over the queries after them."""
    rows = (row for batch in it for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    row = next(rows, None)
    while row is not None:
        pair, held = row[:2], []
        while row is not None and row[:2] == pair and not row[2]:
            held.append(row)
            row = next(rows, None)

        def asked():
            nonlocal row
            while row is not None and row[:2] == pair:
                yield row
                row = next(rows, None)

        yield held, asked()
        for _ in asked():
            pass


def _search(pairs: DataFrame, k: int, widest: int) -> DataFrame:
    """``query, query_id, vec_id, score`` of each shard and block."""
    def run(it):
        for held, asked in _tasks(it):
            if not held:
                continue
            held.sort(key=lambda r: (r[4] is not None, r[4] or 0, r[3]))
            shard = None
            for _, _, _, own, query_id, v, floor in asked:
                if shard is None:
                    shard = Shard([np.frombuffer(r[5], dtype="<i4") for r in held], np.array([r[3] for r in held]), widest)
                found, score = shard.search(np.frombuffer(v, dtype="<i4"), own, k, floor)
                for at, s in zip(found.tolist(), score.tolist(), strict=True):
                    yield own, query_id, held[at][4], s

    return map_rows(pairs, run, [("query", pa.int64(), "long"), ("query_id", pa.int64(), "long"),
                                 ("vec_id", pa.int64(), "long"), ("score", pa.int64(), "long")])


def search(df: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: int = 64, shard_rows: int = 8192, block_rows: int = 2048) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all other rows for each row where ``is_query``."""
    made = weights(df, is_query, id_col=id_col, vec_col=vec_col, scale=scale)
    rows = materialize(made.withColumn("row", F.monotonically_increasing_id()), "topk_rows")
    n, asked, widest = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("query").cast("long")), F.lit(0)),
                                F.coalesce(F.max("most"), F.lit(0))).collect()[0]
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // block_rows))
    shard, block = F.pmod(F.xxhash64("row"), F.lit(shards)), F.pmod(F.xxhash64("row"), F.lit(blocks))
    queries = rows.where("query").select("row", "vec_id", "v", block.alias("block"))
    candidates = rows.select("row", "vec_id", "v", shard.alias("shard"))
    top = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = rows.sparkSession.createDataFrame([], "query long, query_id long, vec_id long, score long")

    low, high = 0, 1
    while low < shards:
        high = min(high, shards)
        floor = best.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        one = (candidates.where(F.col("shard").between(low, high - 1))
               .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
               .select("shard", "block", F.lit(False).alias("asks"), "row", "vec_id", "v", F.lit(None).cast("long").alias("floor")))
        two = (queries.join(floor, F.col("row") == F.col("query"), "left")
               .withColumn("shard", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long"))))
               .select("shard", "block", F.lit(True).alias("asks"), "row", "vec_id", "v", "floor"))
        tasks = min((high - low) * blocks, _TASKS)
        of = F.pmod((F.col("shard") - low) * blocks + F.col("block"), F.lit(tasks)).cast("int")
        pairs = (one.unionByName(two).repartitionById(tasks, of).sortWithinPartitions("shard", "block", "asks", "row"))
        found = best.unionByName(_search(pairs, k, widest))
        best = materialize(found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).drop("rank"), "topk_best")
        low, high = high, high + (high - low) * _GROWTH
    return best.select("query_id", F.row_number().over(top).alias("rank"), "vec_id", "score")
