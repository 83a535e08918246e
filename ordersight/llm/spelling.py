"""Spelling variants: words one edit apart, by dense prefix-suffix tiles.

1. *Words*: runs of Latin-1 letters of whole texts, counted a document at a time
   in the tasks and added up by word.
2. *Groups*: of two words one edit apart, the shorter of length L, either the
   first ``L // 2`` code points agree or the last ``L - L // 2`` do. So each word
   goes into four groups: by beginning and by end, as the shorter and as the
   longer word. Groups of one word end here.
3. *Tiles*: the words of a group, most frequent first, are rows of a matrix of
   code points, and a copy of it is aligned at the words' ends. Two blocks are
   compared in one dense step: the common prefix plus the common suffix reach
   the longer length minus one exactly if the words are one edit apart. Small
   groups are stacked to one tile; a large one is dealt to tasks as pairs of
   blocks, so that none is one task's.
4. *Forms*: a tile returns for each word its number of near words and the most
   frequent one, not the pairs. These are added up by word.
5. *Roots*: forms at least double in count, so a chain is short; the roots are
   found by joining forms to forms, which halves the chains in each round.

Defined cases: a null or empty text has no words. A null id is written as no
digits where ids tell which occurrences are changed. Repeated rows count as
often as they occur. Runs of any length are words, and long texts are read
whole. An empty table gives no rows. Columns other than the id and the text are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import id_text, map_rows, texts

#: In UTF-8, U+00C0 to U+00FF are the byte C3 and a second one.
_RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_HELD = 300_000
_BLOCK, _BLOCK_BYTES = 512, 1 << 20
_CELLS = 1 << 18


def words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3,
          drop_every: int = 97) -> DataFrame:
    """``word, n``: words of at least ``least_length`` code points and ``least_count`` occurrences.

    A-Z count as a-z. Where ``drop_every`` divides the crc32 of ``id:run``, the occurrences of the run in the
    document lose the code point at that number modulo the run's length.
    """
    def run(it):
        held: Counter[bytes] = Counter()
        for batch in it:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                own = Counter(_RUNS.findall(text.lower()))  # of bytes, so A-Z only
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for w, n in own.items():
                    h = zlib.crc32(w, start)
                    if h % drop_every == 0:
                        x = w.decode()
                        w = (x[:h % len(x)] + x[h % len(x) + 1:]).encode()
                    held[w] += n
                if len(held) > _HELD:
                    yield from told(held)
                    held.clear()
        yield from told(held)

    def told(held):
        for w, n in held.items():
            x = w.decode()
            if len(x) >= least_length:
                yield x, n

    return (map_rows(id_text(docs, id_col, text_col), run, [("word", pa.string(), "string"), ("n", pa.int64(), "long")])
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


def _grouped(counted: DataFrame) -> DataFrame:
    """``key, short, end, word, n, i, j, blk``: the words of each group, dealt to pairs of blocks."""
    size = F.length("word")
    keys = F.flatten(F.transform(F.array(size, size - 1), lambda short: F.array(
        F.struct(short.alias("short"), F.lit(False).alias("end"), F.substring(F.col("word"), F.lit(1), F.floor(short / 2).cast("int")).alias("part")),
        F.struct(short.alias("short"), F.lit(True).alias("end"),
                 F.right(F.col("word"), (short - F.floor(short / 2)).cast("int")).alias("part")))))
    of = counted.withColumn("g", F.explode(keys)).select("word", "n", "g.short", "g.end", "g.part").where("short > 0")
    key = ["short", "end", "part"]
    sizes = of.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1")
    rows = F.greatest(F.lit(1), F.least(F.lit(_BLOCK), F.floor(F.lit(_BLOCK_BYTES) / F.col("short"))))
    blocks = F.ceil(F.col("k") / rows).cast("int")
    return (of.join(sizes, key).withColumn("blk", F.pmod(F.xxhash64("word"), blocks).cast("int"))
            .withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumn("i", F.least("blk", "o")).withColumn("j", F.greatest("blk", "o")).drop("o", "k"))


def matrix(some: list[bytes], width: int, at_end: bool = False) -> np.ndarray:
    """Latin-1 words as rows of code points, padded with 0 behind, or in front."""
    pad = bytes.rjust if at_end else bytes.ljust
    return np.frombuffer(b"".join([pad(w, width, b"\0") for w in some]), dtype=np.uint8).reshape(len(some), width)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row of ``x`` and each of ``y``: (tiles, rows, width) each."""
    out = np.zeros((x.shape[0], x.shape[1], y.shape[1]), dtype=np.int32)
    alive = np.ones(out.shape, dtype=bool)
    for c in range(x.shape[2]):
        alive &= x[:, :, None, c] == y[:, None, :, c]
        if not alive.any():
            break
        out += alive
    return out


def near(x: list[list[bytes]], y: list[list[bytes]], short: int, end: bool) -> np.ndarray:
    """Which words of each list of ``x`` are one edit from which of ``y``; lists of a length, b"" as padding.

    All words have ``short`` or one more code points. Pairs of two longer words are another group's, and pairs
    in a group of ends that have the beginning of such a group in common are that one's.
    """
    width, rows, cols = short + 1, len(x[0]), len(y[0])
    flat_x, flat_y = [w for tile in x for w in tile], [w for tile in y for w in tile]
    shape_x, shape_y = (len(x), rows, width), (len(y), cols, width)
    front = _common(matrix(flat_x, width).reshape(shape_x), matrix(flat_y, width).reshape(shape_y))
    back = _common(matrix(flat_x, width, True).reshape(shape_x)[:, :, ::-1], matrix(flat_y, width, True).reshape(shape_y)[:, :, ::-1])
    len_x = np.array([len(w) for w in flat_x]).reshape(len(x), rows, 1)
    len_y = np.array([len(w) for w in flat_y]).reshape(len(y), 1, cols)
    longer = np.maximum(len_x, len_y)
    ok = (np.minimum(len_x, len_y) == short) & (front < longer)  # equal words have a whole beginning in common
    # padding may agree with padding: no more than the shorter word has
    ok &= np.minimum(front, short) + np.minimum(back, short) >= longer - 1
    return ok & (front < short // 2) if end else ok


def _told(tile: list[tuple[bytes, int]], other: list[tuple[bytes, int]], ok: np.ndarray):
    """``word, n_near, best_n, best`` of the words of ``tile``; ``other`` is sorted, best first."""
    count = ok.sum(axis=1)
    first = ok.argmax(axis=1)
    for k in np.flatnonzero(count):
        best, n = other[first[k]]
        yield tile[k][0].decode("latin-1"), int(count[k]), n, best.decode("latin-1")


def compare(grouped: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of each tile."""
    def run(it):
        held: dict[tuple, list] = {}  # groups of like size, until they fill a tile
        waiting = 0

        def groups():
            key, blocks = None, ([], [])
            for batch in it:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if row[:5] != key:
                        if key:
                            yield key, blocks
                        key, blocks = row[:5], ([], [])
                    blocks[row[5] != row[3]].append((row[6].encode("latin-1"), row[7]))
            if key:
                yield key, blocks

        def done(short, end, size):
            tiles = held.pop((short, end, size))
            padded = [[w for w, _ in t] + [b""] * (size - len(t)) for t in tiles]
            for t, ok in zip(tiles, near(padded, padded, short, end), strict=True):
                yield from _told(t, t, ok)

        for (short, end, _, i, j), (one, two) in groups():
            if i != j:
                if one and two:
                    ok = near([[w for w, _ in one]], [[w for w, _ in two]], short, end)[0]
                    yield from _told(one, two, ok)
                    yield from _told(two, one, ok.T)
                continue
            size = 1 << (len(one) - 1).bit_length()
            own = held.setdefault((short, end, size), [])
            own.append(one)
            waiting += size * short
            if len(own) * size * size >= _CELLS:
                waiting -= len(own) * size * short
                yield from done(short, end, size)
            elif waiting > _BLOCK_BYTES:
                for k in list(held):
                    yield from done(*k)
                waiting = 0
        for k in list(held):
            yield from done(*k)

    flat = (grouped.repartition("short", "end", "part", "i", "j")
            .sortWithinPartitions("short", "end", "part", "i", "j", F.desc("n"), "word")
            .select("short", "end", "part", "i", "j", "blk", "word", "n"))
    return map_rows(flat, run, [("word", pa.string(), "string"), ("n_near", pa.int64(), "long"),
                                ("best_n", pa.int64(), "long"), ("best", pa.string(), "string")])


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words with a form: each round joins the ends of the chains to the chains they begin."""
    ends = materialize(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialize(ends.join(on, "root", "left"), "spelling_roots")
        ends = joined.select("word", F.coalesce("next", "root").alias("root"))
        if not joined.where("next is not null").limit(1).count():
            return ends


def variants(docs: DataFrame, *, ratio: int = 2, **options) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word.

    ``form`` is the near word of largest ``n`` (ties: the smallest), if that is at least ``ratio`` times the word's.
    """
    counted = materialize(words(docs, **options), "spelling_words")
    found = compare(_grouped(counted)).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first"))
    is_form = -F.col("first.less") >= ratio * F.col("n")
    all_ = materialize(counted.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("first.best")).alias("form"), F.when(is_form, -F.col("first.less")).alias("form_n")), "spelling_forms")
    roots = _roots(all_.where("form is not null"))
    return (all_.join(roots, "word", "left")
            .select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")))
