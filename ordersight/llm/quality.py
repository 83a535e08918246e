"""Ordinal cumulative-link regression on graded ratings.

A text is a bag of hashed features: its words, the first letters of its words
(so that inflected or compounded forms share weight), and a few facts about its
shape (share of repeated words, of symbols, of capitals, length), each counted
once a text. With weights ``w`` shared by all grades and ordered thresholds
``t_1 <= ... <= t_K``, ``P(grade >= k) = sigmoid(w . x - t_k)``. The expected
grade is the sum of these, and a text is selected if ``P(grade >= keep_grade)``
reaches ``min_tail``. Rare grades weigh more in the fit; where labels are few,
that alone would put a text without evidence under one half, so a threshold is
lowered, if need be, until ``least_kept`` of the labelled rows at or above its
grade are on its upper side.

The fit uses labelled rows only: at most ``max_train`` of them, the ones with
the smallest hash of their id, so that the bound neither depends on order nor
prefers a source. Their features are made in tasks; the weights (``buckets``
numbers) are fitted on the driver and sent to the tasks, sizes that do not grow
with the corpus. Every document is scored over its whole text in one map.

Defined cases: a null text is an empty one, whose only features are those of
its shape. A null id is scored and kept. Labels that are null, or that name no
document, are not used; a repeated label or labelled document counts once. Without
labelled rows there is nothing to learn, and every text gets probability 1/2 of
each tail. An empty table of documents gives no rows. A text is
read whole, however long, in time linear in its length. Columns other than id,
text and rating are not read; ``select`` keeps them as they are.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import foremost, id_text, map_rows, releasing, texts

BUCKETS = 1 << 18
_STEMS = (4, 5)
_CACHE = 100_000
_SYMBOLS = re.compile(rb"[^\w\s\x80-\xff.,;:'\"()-]")


@functools.lru_cache(maxsize=1)
def _cache() -> dict[bytes, tuple[int, ...]]:
    return {}


def features(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Distinct feature numbers of a text, sorted."""
    cache = _cache()
    if len(cache) > _CACHE:
        cache.clear()
    raw = text.split()
    distinct = set(raw)
    out = set()
    for w in distinct:
        got = cache.get(w)
        if got is None:
            low = w.decode("utf-8", "replace").lower()
            got = cache[w] = (zlib.crc32(low.encode()) % buckets, *(
                zlib.crc32(b"%d%s" % (k, low[:k].encode())) % buckets for k in _STEMS))
        out.update(got)
    n = max(1, len(raw))
    marks = (f"repeat{10 * (len(raw) - len(distinct)) // n if n < 400 else 10 + 10 * (len(raw) - len(distinct)) // n}",
             f"symbols{min(40, 100 * len(_SYMBOLS.findall(text)) // max(1, len(text)))}",
             f"capitals{10 * sum(map(text.count, _CAPITALS)) // max(1, len(text))}",
             f"length{len(raw).bit_length()}", f"lines{10 * text.count(b'\n') // n}")
    out.update(zlib.crc32(b"\2" + m.encode()) % buckets for m in marks)
    return np.fromiter(sorted(out), dtype=np.int32, count=len(out))


_CAPITALS = [bytes([c]) for c in range(65, 91)]


def grade(quality: Column, toxic: Column) -> Column:
    """Graded rating of a label row: 0 poor, 1 fluent but toxic, 2 good; null if either is null."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(quality == 0, 0).when(toxic == 1, 1).otherwise(2)


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, *, buckets: int = BUCKETS,
        min_chi2: float = 5.0, least_kept: float = 0.97, steps: int = 120_000, rate: float = 0.05, shrink: float = 0.3,
        balance: float = 1.0, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds, by AdaGrad steps on the cumulative logistic loss.

    Only features whose document counts differ between grades (``min_chi2``) get
    a weight, and weights shrink towards zero; otherwise rare words fit the
    sample and nothing else. A feature counts by its evidence, the largest log
    ratio of its shares in adjacent grades: one that tells two grades apart keeps
    its weight where many that say little of themselves lose theirs, and is not
    outvoted in a long text. Rare grades weigh more (to the power ``balance``).
    """
    w, t = np.zeros(buckets), np.linspace(-1, 1, n_grades - 1)
    if not rows:
        return w, np.zeros(n_grades - 1)
    size = np.bincount(grades, minlength=n_grades).astype(float)
    count = np.zeros((n_grades, buckets))
    for x, y in zip(rows, grades, strict=True):
        count[y, x] += 1
    expected = count.sum(axis=0) * (size / size.sum())[:, None]
    keep = ((count - expected) ** 2 / np.maximum(expected, 1e-9)).sum(axis=0) >= min_chi2
    keep &= count.sum(axis=0) >= 5
    share = np.log((count + 0.5) / (size[:, None] + 1))
    evidence = np.abs(np.diff(share, axis=0)).max(axis=0)
    rows = [x[keep[x]] for x in rows]
    weight = (size.sum() / (n_grades * np.maximum(1, size))) ** balance
    sq_w, sq_t = np.full(buckets, 1e-2), np.full(n_grades - 1, 1e-2)
    order = np.random.default_rng(seed)
    for _ in range(min(40, -(-steps // len(rows)))):
        for i in order.permutation(len(rows)):
            x, y = rows[i], grades[i]
            by = evidence[x]
            # gradient by each threshold of the log-losses of P(grade >= k)
            p = 1 / (1 + np.exp(np.clip(t - w[x] @ by, -30, 30)))
            g = weight[y] * (p - (np.arange(1, n_grades) <= y))
            gw = g.sum() * by
            sq_w[x] += gw * gw
            step = rate / np.sqrt(sq_w[x])
            v = w[x] - step * gw
            w[x] = np.sign(v) * np.maximum(0, np.abs(v) - step * shrink)
            sq_t += g * g
            t = np.sort(t + rate * g / np.sqrt(sq_t))
    w *= evidence
    z = np.array([w[x].sum() for x in rows])
    for k in range(1, n_grades):
        above = np.sort(z[grades >= k])
        if len(above):
            t[k - 1] = min(t[k - 1], above[int((1 - least_kept) * len(above))])
    return w, np.minimum.accumulate(t[::-1])[::-1]


def train(docs: DataFrame, labels: DataFrame, rating: Column, n_grades: int, *, id_col: str = "doc_id",
          text_col: str = "text", label_id: str = "doc_id", buckets: int = BUCKETS, max_train: int = 12_000,
          **options) -> tuple[np.ndarray, np.ndarray]:
    """Fit on the ``max_train`` labelled rows with the smallest hash of their id."""
    rated = (labels.select(F.col(f"`{label_id}`").cast("long").alias("lid"), rating.cast("int").alias("grade"))
             .where("lid is not null and grade is not null").distinct())
    rated = foremost(rated, max_train, F.shiftright(F.xxhash64("lid"), 52)).orderBy(F.xxhash64("lid"), "lid", "grade").limit(max_train)
    chosen = id_text(docs, id_col, text_col).join(F.broadcast(rated), F.col("doc_id") == F.col("lid"))

    def run(it):
        for batch in it:
            for lid, y, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), texts(batch.column(2)), strict=True):
                yield lid, y, features(text, buckets).tobytes()

    got = (map_rows(chosen.select("lid", "grade", "text"), run,
                    [("lid", pa.int64(), "long"), ("grade", pa.int32(), "int"), ("x", pa.binary(), "binary")])
           .groupBy("lid", "grade").agg(F.min("x").alias("x")).collect())
    got.sort(key=lambda r: (r.grade, bytes(r.x)))
    return fit([np.frombuffer(r.x, dtype=np.int32) for r in got], np.array([r.grade for r in got], dtype=int),
               n_grades, buckets=buckets, **options)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text",
          keep_grade: int = 2, min_tail: float = 0.5, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, expected_grade, tails array<double>, tail double, selected boolean`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def run(it):
        w, t = sent.value
        for batch in it:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                z = float(w[features(text, buckets)].sum(dtype=np.float64))
                p = 1 / (1 + np.exp(np.clip(t - z, -700, 700)))
                tail = float(p[keep_grade - 1])
                yield doc_id, float(p.sum()), p.tolist(), tail, tail >= min_tail
        _cache().clear()  # the worker may serve other jobs

    return map_rows(id_text(docs, id_col, text_col), run, [
        ("doc_id", pa.int64(), "long"), ("expected_grade", pa.float64(), "double"),
        ("tails", pa.list_(pa.float64()), "array<double>"), ("tail", pa.float64(), "double"),
        ("selected", pa.bool_(), "boolean")])


def select(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], *, text_col: str = "text", keep_grade: int = 2,
           min_tail: float = 0.5, buckets: int = BUCKETS) -> DataFrame:
    """The selected documents, row by row, with their columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    at = docs.columns.index(text_col)

    def run(it):
        w, t = sent.value
        for batch in it:
            z = np.array([w[features(x, buckets)].sum(dtype=np.float64)
                          for x in texts(batch.column(at).cast(pa.string()))])
            keep = 1 / (1 + np.exp(np.clip(t[keep_grade - 1] - z, -700, 700))) >= min_tail
            yield batch.filter(pa.array(keep, type=pa.bool_()))
        _cache().clear()

    return docs.mapInArrow(lambda it: releasing(run(it)), docs.schema)
