"""Scoring documents with a gated recurrent language model that is trained on the corpus.

1. *Counts*: words are counted over all training documents, pre-aggregated in
   the tasks. The ``head`` most frequent ones (a stated bound) are known to all
   tasks; counts of the others are joined by word.
2. *Tokens*: every whole document becomes numbers once, in a written table:
   the most frequent words have their own number, the others that of a bucket.
3. *Training*: the model of ``gru`` passes over all training documents once, in
   rounds that grow fourfold. In a round each task trains on its own documents
   from the same parameters, and the results are averaged by tokens, in two
   levels, so no task and not the driver ever holds more than a few models.
4. *Scores*: each document's log-likelihood under the final model, its state
   carried over all its windows. A word of a bucket has the bucket's
   probability times ``(count + 1/2)`` over the bucket's sum of these; half a
   count stands for all words not seen in training.

The base score is the unigram model with half a count added, over the same
tokens: words in lower case (A-Z) between ASCII white space, and one end.

Defined cases: a null text is an empty one, which is its end token alone. A null
id belongs to the training part and is kept. Repeated rows are documents of
their own and count as often as they occur. Without training documents every
count is 0 and the model is as it starts. An empty table gives no rows. Columns
other than id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import gru
from .common import foremost, id_text, map_rows, texts

END = b""  # no word is empty
_COUNTED = 500_000
_CHUNK = 6_000_000
_SLICES = 64
#: Upper slices of the rounds: 1/64, 4/64, 16/64 and the rest of the training documents.
_ROUNDS = ((0, 1), (1, 5), (5, 21), (21, 64))
_PIECES = 8


def bucket(word: bytes) -> int:
    """Number of the bucket of a word that has no number of its own."""
    return gru.WORDS + zlib.crc32(word[-2:]) % gru.BUCKETS


def parts(docs: DataFrame) -> DataFrame:
    """``doc_id, text, held_out``: crc32 of the id as text, modulo 5, is 1."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)))


def count_words(split: DataFrame) -> DataFrame:
    """``(word binary, c)`` over the training documents, the end token included."""
    def run(it):
        seen: Counter = Counter()
        for batch in it:
            for text in texts(batch.column(0)):
                seen.update(text.lower().split())
                seen[END] += 1
                if len(seen) > _COUNTED:
                    yield from seen.items()
                    seen.clear()
        yield from seen.items()

    rows = map_rows(split.where("not held_out").select("text"), run,
                    [("word", pa.binary(), "binary"), ("c", pa.int64(), "long")], size=20_000)
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


TOKENS = [("row", pa.int64(), "long"), ("doc_id", pa.int64(), "long"), ("held_out", pa.bool_(), "boolean"),
          ("slice", pa.int32(), "int"), ("n", pa.int64(), "long"), ("known", pa.int64(), "long"),
          ("logs", pa.float64(), "double"), ("in_bucket", pa.binary(), "binary"), ("ids", pa.binary(), "binary"),
          ("words", pa.list_(pa.binary()), "array<binary>"), ("tfs", pa.list_(pa.int32()), "array<int>")]


def tokenize(split: DataFrame, head: list[tuple[bytes, int]]) -> DataFrame:
    """A row for each document: its token numbers and what the scores need of them.

    ``logs``: sum of log10(count + 1/2) of the head's words in it; ``in_bucket``: the same sum over
    those with a bucket, then the tokens in each bucket; ``words``, ``tfs``: its words beyond the head.
    """
    known = split.sparkSession.sparkContext.broadcast(head)
    state: dict = {}

    def tables():
        if not state:
            words = known.value
            state["rank"] = {w: k for k, (w, _) in enumerate(words)}
            state["log"] = np.log10(np.array([c for _, c in words] + [0.5], dtype=float) + 0.5)
            state["id"] = np.array([k if k < gru.WORDS else bucket(w) for k, (w, _) in enumerate(words)] + [0], dtype="<u2")
        return state["rank"], state["log"], state["id"]

    def run(it):
        rank, log, number = tables()
        row = TaskContext.get().partitionId() << 33
        for batch in it:
            for doc_id, held, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), texts(batch.column(2)), strict=True):
                words = text.lower().split()
                words.append(END)
                at = np.array([rank.get(w, -1) for w in words], dtype=np.int64)
                ids = number[at]
                far = np.flatnonzero(at < 0)
                rest = [words[k] for k in far.tolist()]
                tail = Counter(rest)
                if rest:
                    ids[far] = [bucket(w) for w in rest]
                inside = at[at >= 0]
                deep = inside[inside >= gru.WORDS]
                sums = np.bincount(ids[ids >= gru.WORDS].astype(int) - gru.WORDS, minlength=gru.BUCKETS).astype("<u4")
                cut = zlib.crc32(text) % _SLICES
                own = np.array([log[deep].sum()]).tobytes() + sums.tobytes()
                yield (row, doc_id, held, cut, len(words), len(inside), float(log[inside].sum()), own, ids.tobytes(),
                       list(tail), list(tail.values()))
                row += 1

    return map_rows(split.select("doc_id", "held_out", "text"), run, TOKENS, size=2000)


def _documents(it, column: int):
    """Token arrays in chunks of about ``_CHUNK`` tokens, with their other columns."""
    held, size = [], 0
    for batch in it:
        for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
            ids = np.frombuffer(row[column], dtype="<u2")
            held.append((row, ids))
            size += len(ids)
            if size >= _CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def train(tokens: DataFrame, first: np.ndarray) -> np.ndarray:
    """Parameters after one pass over all training documents."""
    spark, flat = tokens.sparkSession, first
    square = np.full(gru.SIZE, 1e-4, dtype=np.float32)
    docs = tokens.where("not held_out")
    piece = [("g", pa.int64(), "long"), ("piece", pa.int64(), "long"), ("weight", pa.float64(), "double"),
             ("x", pa.binary(), "binary")]

    for low, high in _ROUNDS:
        sent = spark.sparkContext.broadcast((flat, square))

        def run(it, sent=sent):
            p, s = sent.value
            seen = 0
            for chunk in _documents(it, 0):
                p, s = gru.train(p, s, [ids for _, ids in chunk])
                seen += sum(len(ids) for _, ids in chunk)
            if seen:
                both = np.concatenate([p, s])
                for k, x in enumerate(np.array_split(both, _PIECES)):
                    yield TaskContext.get().partitionId(), k, float(seen), x.tobytes()

        def add(it):
            sums: dict[tuple[int, int], list] = {}
            for batch in it:
                for g, k, w, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    x = np.frombuffer(x, dtype=np.float32).astype(np.float64) * w
                    got = sums.setdefault((g, k), [0.0, np.zeros_like(x)])
                    got[0] += w
                    got[1] += x
            for (g, k), (w, x) in sums.items():
                yield g, k, w, (x / w).astype(np.float32).tobytes()

        made = map_rows(docs.where(F.col("slice").between(low, high - 1)).select("ids"), run, piece, size=_PIECES)
        # groups of 64 tasks, then the groups: a task adds up as it reads, and holds one sum a group
        some = map_rows(made.withColumn("g", F.floor(F.col("g") / 64)).repartition("g", "piece"), add, piece, size=_PIECES)
        all_ = map_rows(some.withColumn("g", F.lit(0).cast("long")).repartition(_PIECES, "piece"), add, piece, size=_PIECES)
        got = {r.piece: np.frombuffer(r.x, dtype=np.float32) for r in all_.collect()}  # one model
        if got:
            both = np.concatenate([got[k] for k in range(_PIECES)])
            flat, square = both[:gru.SIZE].copy(), both[gru.SIZE:].copy()
    return flat


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", head: int = 200_000) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    split = parts(id_text(docs, id_col, text_col))
    vocab = materialize(count_words(split), "lm_vocab")
    total, distinct = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).collect()[0]
    ends = vocab.where(F.col("word") == F.lit(END)).collect()
    # by count, beyond 4096 in steps of a hundredth, then by hash
    often = -F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor(64 * F.log2(F.col("c") / 4096)))
    chance = F.xxhash64("word")
    words = vocab.where(F.col("word") != F.lit(END))
    top = foremost(words, head, often, F.shiftright(chance, 52)).orderBy(often, chance, "word").limit(head).collect()
    known = [(END, ends[0].c if ends else 0)] + sorted(((bytes(r.word), r.c) for r in top), key=lambda x: (-x[1], x[0]))
    # Sums over the buckets: the words without a number of their own, and half a count for the unseen.
    named = docs.sparkSession.createDataFrame([(w,) for w, _ in known[:gru.WORDS]], "word binary")
    by_bucket = (vocab.join(F.broadcast(named), "word", "left_anti")
                 .groupBy((F.crc32(F.substring("word", -2, 2)) % gru.BUCKETS).cast("int").alias("b"))
                 .agg(F.sum("c").alias("c"), F.count("*").alias("k")).collect())
    mass, held = np.full(gru.BUCKETS, 0.5), np.zeros(gru.BUCKETS)
    for r in by_bucket:
        mass[r.b] += r.c + 0.5 * r.k
        held[r.b] = r.c
    counts = np.zeros(gru.WORDS)
    n_words = min(len(known), gru.WORDS)
    counts[:n_words] = [c for _, c in known[:n_words]]
    of_class = counts.reshape(gru.CLASSES, gru.MEMBERS).sum(axis=1)
    share = np.concatenate([of_class, held]) + 0.5
    member = (counts.reshape(gru.CLASSES, gru.MEMBERS) + 0.5) / (of_class[:, None] + 0.5 * gru.MEMBERS)
    first = gru.start(n_words, share / share.sum(), member.ravel())

    tokens = materialize(tokenize(split, known), "lm_tokens")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((train(tokens, first), np.log10(mass)))

    def run(it):
        flat, log_mass = sent.value
        for chunk in _documents(it, 6):
            got = gru.log_likelihood(flat, [ids for _, ids in chunk]) / math.log(10)
            for ((row, doc_id, out, n, known_n, logs, _, own), _), x in zip(chunk, got.tolist(), strict=True):
                deep, buckets = np.frombuffer(own[:8])[0], np.frombuffer(own[8:], dtype="<u4")
                yield row, doc_id, out, n, known_n, logs, x + float(deep) - float(buckets @ log_mass)

    rows = tokens.select("row", "doc_id", "held_out", "n", "known", "logs", "ids", "in_bucket")
    scored = map_rows(rows, run, [("row", pa.int64(), "long"), ("doc_id", pa.int64(), "long"),
                                  ("held_out", pa.bool_(), "boolean"), ("n_tokens", pa.int64(), "long"),
                                  ("known", pa.int64(), "long"), ("logs", pa.float64(), "double"),
                                  ("model", pa.float64(), "double")])
    far = (tokens.select("row", F.explode(F.arrays_zip("words", "tfs")).alias("t"))
           .select("row", F.col("t.words").alias("word"), F.col("t.tfs").alias("tf"))
           .join(vocab.withColumnRenamed("c", "count"), "word", "left")
           .withColumn("count", F.coalesce("count", F.lit(0)))
           .groupBy("row").agg(F.sum(F.when(F.col("count") > 0, F.col("tf")).otherwise(0)).alias("far_known"),
                               F.sum(F.col("tf") * F.log10(F.col("count") + 0.5)).alias("far_logs")))
    norm = math.log10(total + 0.5 * (distinct + 1))
    zero = F.lit(0.0)
    # without training documents the end token has count 0 and is not known
    seen = F.col("known") if total else F.lit(0).cast("long")
    return (scored.join(far, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (seen + F.coalesce("far_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("far_logs", zero) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("model") + F.coalesce("far_logs", zero)).alias("score")))
