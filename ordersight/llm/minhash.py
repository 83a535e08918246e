"""MinHash near-duplicates with min-max hashing.

1. *Signatures*: each document's distinct word shingles, as 64-bit hashes, go
   through ``PERMS`` permutations; the least and the greatest value of each are
   kept, so half as many hash evaluations give a signature of ``2 * PERMS``
   values, whose share of agreement estimates the Jaccard similarity.
2. *Classes*: documents with equal shingle sets are one class from here on.
3. *Bands*: four values of four different permutations make a band; classes
   that share a band are candidates. At similarity 0.75 a pair shares no band
   with probability 5e-6.
4. *Stars*: each class is confirmed, on full sets, against the smallest class
   that it shares most bands with; confirmed links give components.
5. *Rest*: in buckets that still hold several components, members outside the
   largest one are compared with all others of the bucket. The signatures (one
   byte of each value) tell which members may have a link across components that
   no earlier band has shown: those that agree in ``MAYBE`` of the values (3.9
   standard errors under the threshold) and are of like size. Only they get
   their sets, and their pairs are confirmed inside the task, which returns
   spanning links. Large buckets are dealt to tasks as pairs of blocks, so no
   bucket is one task's and none is expanded into rows of pairs.

Defined cases: a null, empty or wordless text has an empty set and is linked
with nothing. Documents of less than ``width`` words have one shingle; longer
ones are shingled whole, however long. Rows with a null id have no component and
are kept. Rows of one id are one
document that has all their links, also if their texts differ; repeated rows are
returned as often as they occur. An empty table gives no rows. Columns other
than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import arrow_rows, materialize
from .common import id_text, map_rows, texts
from .components import components

PERMS, ROWS = 64, 4
BANDS = 2 * PERMS // ROWS
MAYBE = 0.60
#: Members of a block, and the sizes of their sets in all, about.
_BLOCK, _BLOCK_SHINGLES = 4096, 2_000_000
#: Rows of a batch: texts and sets are several KB each.
_BATCH = 500
_rng = np.random.default_rng(20_240_229)
_A = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2)
_K = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Band b: the minima of permutations 2b, 2b+1 and the maxima of the next two.
_ORDER = np.array([i for b in range(BANDS) for i in (2 * b, 2 * b + 1, PERMS + (2 * b + 2) % PERMS,
                                                      PERMS + (2 * b + 3) % PERMS)])


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles. A-Z count as a-z; words part at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(w) for w in words]), dtype=">u8").astype(np.uint64)
    n = min(width, len(words))
    s = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        s += h[k:k + len(s)] * _K[k]
    s ^= s >> np.uint64(31)
    s *= _K[63]
    s ^= s >> np.uint64(29)
    return np.unique(s)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 32-bit minima and maxima, in band order, for each non-empty set."""
    x = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out, h = np.empty((len(sets), 2 * PERMS), dtype=np.uint32), np.empty_like(x)
    for i in range(PERMS):
        np.multiply(x, _A[i], out=h)
        np.add(h, _B[i], out=h)
        out[:, i] = np.minimum.reduceat(h, starts) >> np.uint64(32)
        out[:, PERMS + i] = np.maximum.reduceat(h, starts) >> np.uint64(32)
    return out[:, _ORDER]


def sign(docs: DataFrame, width: int = 5) -> DataFrame:
    """``doc_id, n, tag, key, sig``: set size, digests of the text and the set, and signature (null if empty)."""
    def run(it):
        for batch in it:
            ids, chunk, held = batch.column(0).to_pylist(), [], 0
            for doc_id, text in zip(ids, texts(batch.column(1)), strict=True):
                s = shingles(text, width)
                if not len(s):
                    yield doc_id, 0, None, None, None
                    continue
                chunk.append(((doc_id, len(s), hashlib.md5(text).digest()), s))
                held += len(s)
                if held > 60_000:
                    yield from signed(chunk)
                    chunk, held = [], 0
            yield from signed(chunk)

    def signed(chunk):
        if chunk:
            for (doc, s), sig in zip(chunk, signatures([s for _, s in chunk]), strict=True):
                yield *doc, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sig.tobytes()

    return map_rows(docs, run, [("doc_id", pa.int64(), "long"), ("n", pa.int64(), "long"),
                                ("tag", pa.binary(), "binary"), ("key", pa.binary(), "binary"), ("sig", pa.binary(), "binary")],
                    size=_BATCH)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b, linked)`` of the pairs, from their full sets."""
    own = (pairs.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b")
           .join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a"))

    def run(it):
        for batch in it:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), dtype=np.uint64) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                yield a[k], b[k], 100 * both >= percent * (len(x) + len(y) - both)

    return map_rows(own.select("a", "b", "set_a", "set_b"), run,
                    [("a", pa.int64(), "long"), ("b", pa.int64(), "long"), ("linked", pa.bool_(), "boolean")])


def _groups(it) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of equal (key, i, j) over sorted batches: the key and the columns after it."""
    key, held = None, []
    for batch in it:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != key:
                if held:
                    yield key, held
                key, held = row[:3], []
            held.append(row[3:])
    if held:
        yield key, held


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(y)), dtype=np.uint8)
    for p in range(x.shape[1]):
        out += x[:, p, None] == y[None, :, p]
    return out


def _sides(blk: np.ndarray, i: int, j: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The members on either side of the pairs a task compares: block i with j, or a block with itself."""
    if i == j:
        both = np.arange(len(blk))
        return [(both, both)]
    left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
    return [(left, right), (right, left)]


def _outside(comp: np.ndarray) -> np.ndarray:
    """Members that aren't in the largest component of a block."""
    u, size = np.unique(comp, return_counts=True)
    return comp != u[size.argmax()]


def _alike(n: np.ndarray, some, two, percent: int) -> np.ndarray:
    x, y = n[some, None], n[None, two]
    return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)


def _maybe(spread: DataFrame, percent: int) -> DataFrame:
    """``(key, rep)``: members that may have a link across components that is this bucket's to confirm.

    A pair that shares several buckets belongs to the largest of them (``keys``, ``sizes``: of each
    band's bucket, 0 where the member is alone), so that few buckets need the set of a document. Equal
    keys tell what is shared: both are in that bucket, so the one that owns the pair does see it.
    """
    def run(it):
        for (key, i, j), rows in _groups(it):
            rep, comp, n, blk, band, sig, keys, sizes = zip(*rows, strict=True)
            keys = np.frombuffer(b"".join(keys), dtype=">i8").reshape(len(rep), BANDS)
            sizes = np.frombuffer(b"".join(sizes), dtype=">i4").reshape(len(rep), BANDS)
            if len(rep) == 2:
                x, y = (np.frombuffer(v, dtype=np.uint8) for v in sig)
                shared = (keys[0] == keys[1]) & (sizes[0] > 0)
                if comp[0] != comp[1] and (x == y).sum() >= MAYBE * len(x) and 100 * min(n) >= percent * max(n) \
                        and np.where(shared, sizes[0], -1).argmax() == band[0]:
                    yield from ((key, r) for r in rep)
                continue
            comp, n, blk = (np.array(v, dtype=np.int64) for v in (comp, n, blk))
            sig, chosen = np.frombuffer(b"".join(sig), dtype=np.uint8).reshape(len(rep), -1), set()
            out = _outside(comp)
            for one, two in _sides(blk, i, j):
                one = one[out[one]]
                for at in range(0, len(one), 512):
                    some = one[at:at + 512]
                    ok = (_agreement(sig[some], sig[two]) >= MAYBE * sig.shape[1]) & (comp[some, None] != comp[None, two])
                    ok &= _alike(n, some, two, percent)
                    for r in np.flatnonzero(ok.any(axis=1)):
                        c = two[ok[r]]
                        shared = (keys[c] == keys[some[r]]) & (sizes[some[r]] > 0)
                        c = c[np.where(shared, sizes[some[r]], -1).argmax(axis=1) == band[0]]
                        if len(c):
                            chosen.add(int(some[r]))
                            chosen.update(c.tolist())
            yield from ((key, rep[k]) for k in sorted(chosen))

    flat = (spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .select("key", "i", "j", "rep", "comp", "n", "blk", "band", "sig8", "keys", "sizes"))
    return map_rows(flat, run, [("key", pa.int64(), "long"), ("rep", pa.int64(), "long")]).distinct()


def _codes(sets: list[bytes]) -> tuple[list[np.ndarray], int]:
    """The sets in small numbers, and how many numbers there are; ``sets`` is emptied on the way.

    Numbers are looked up set by set in the sorted values: an inverse of them all takes several times their memory.
    """
    values = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in sets])
    values.sort()
    values = values[np.r_[True, values[1:] != values[:-1]]]
    out = []
    for k, x in enumerate(sets):
        out.append(np.searchsorted(values, np.frombuffer(x, dtype=np.uint64)).astype(np.int32))
        sets[k] = b""
    return out, len(values)


def _across(spread: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: links across components, enough to join all that are linked in each bucket."""
    def run(it):
        for (_, i, j), rows in _groups(it):
            rep, comp, blk, sets = map(list, zip(*rows, strict=True))
            rows.clear()
            comp, blk = np.array(comp, dtype=np.int64), np.array(blk, dtype=np.int64)
            own, total = _codes(sets)
            n = np.array([len(x) for x in own])
            mark = np.zeros(total, dtype=np.int32)
            out = _outside(comp)
            for one, two in _sides(blk, i, j):
                for x in one[out[one]]:
                    c = two[(comp[two] != comp[x]) & _alike(n, np.array([x]), two, percent)[0]]
                    if not len(c):
                        continue
                    mark[own[x]] = 1
                    starts = np.cumsum(np.r_[0, n[c][:-1]])
                    both = np.add.reduceat(mark[np.concatenate([own[k] for k in c])], starts)
                    mark[own[x]] = 0
                    for y in c[100 * both >= percent * (n[x] + n[c] - both)]:
                        if comp[y] != comp[x]:
                            yield min(rep[x], rep[y]), max(rep[x], rep[y])
                            comp[comp == comp[y]] = comp[x]

    flat = (spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .select("key", "i", "j", "rep", "comp", "blk", "set"))
    return map_rows(flat, run, [("a", pa.int64(), "long"), ("b", pa.int64(), "long")]).distinct()


def _spread(at: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, dealt to pairs of blocks ``(i, j)``."""
    mixed = (at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.greatest(
        F.ceil(F.count("*") / _BLOCK), F.ceil(F.sum("n") / _BLOCK_SHINGLES)).alias("k")).where("lo <> hi").select("key", "k"))
    blocks = F.col("k").cast("long")
    return (at.join(mixed, "key").withColumn("blk", F.pmod(F.xxhash64("rep"), blocks))
            .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            .withColumn("i", F.least("blk", "o")).withColumn("j", F.greatest("blk", "o")).drop("o", "k"))


def _tag(text: str) -> Column:
    return F.unhex(F.md5(text))


def links(docs: DataFrame, *, width: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signed documents, classes ``(key, rep, doc_id, tag)`` and confirmed links ``(a, b)`` between their numbers.

    Documents with equal sets are one class, known by its number ``rep``; ``(doc_id, tag)`` is its smallest
    document. The links are enough to join every component.
    """
    with arrow_rows(docs.sparkSession, _BATCH):
        return _links(docs, width, percent)


def _links(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    signed = materialize(sign(docs, width), "minhash_signed")
    known = signed.where("n > 0 and doc_id is not null")
    least = F.min(F.struct("doc_id", "tag")).alias("least")
    classes = (known.groupBy("key").agg(least, F.min("n").alias("n"), F.min("sig").alias("sig"))
               .select("key", F.monotonically_increasing_id().alias("rep"), "least.doc_id", "least.tag", "n", "sig"))
    classes = materialize(classes, "minhash_classes")

    # Rows of one id with several texts are one document: its classes belong together.
    several = (known.select("doc_id", F.xxhash64("key").alias("k")).groupBy("doc_id")
               .agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("doc_id"))
    own = (known.join(several, "doc_id", "left_semi").select("doc_id", "key").distinct()
           .join(classes.select("key", "rep"), "key").select("doc_id", "rep"))
    own = materialize(own, "minhash_several")
    same = (own.join(own.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a <> rep")
            .select("a", F.col("rep").alias("b")).distinct())

    span = 4 * ROWS
    banded = classes.select("rep", "n", F.posexplode(F.array(*[
        F.expr(f"xxhash64({b}, substring(sig, {b * span + 1}, {span}))") for b in range(BANDS)])).alias("band", "key"))
    heads = (banded.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("head"), F.count("*").alias("m"))
             .where("m > 1").select("key", F.col("head.rep").alias("lead"), F.col("head.n").alias("lead_n"), "m"))
    buckets = materialize(banded.join(heads, "key"), "minhash_buckets")

    fits = F.lit(100) * F.least("n", "lead_n") >= F.lit(percent) * F.greatest("n", "lead_n")
    stars = materialize(buckets.where((F.col("rep") != F.col("lead")) & fits).groupBy("rep", "lead").count()
                        .groupBy("rep").agg(F.max(F.struct("count", -F.col("lead"))).alias("best"))
                        .select((-F.col("best.col2")).alias("a"), F.col("rep").alias("b")), "minhash_stars")

    def sets_of(members: DataFrame) -> DataFrame:
        def run(it):
            for batch in it:
                for rep, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                    yield rep, shingles(text, width).tobytes()
        # One of the rows of the class's smallest document; the text tells which is meant.
        wanted = classes.join(members, "rep", "left_semi").select("rep", F.col("doc_id").alias("of_id"), F.col("tag").alias("of_tag"))
        rows = (docs.join(wanted, (F.col("doc_id") == F.col("of_id")) & (_tag("text") == F.col("of_tag")))
                .select("rep", "text").dropDuplicates(["rep"]))
        return map_rows(rows, run, [("rep", pa.int64(), "long"), ("set", pa.binary(), "binary")], size=_BATCH)

    ends = stars.select(F.col("a").alias("rep")).unionByName(stars.select(F.col("b").alias("rep"))).distinct()
    tested = materialize(_confirm(stars, materialize(sets_of(ends), "minhash_sets"), percent), "minhash_tested")
    near = tested.where("linked").select("a", "b").unionByName(same)

    comps = materialize(components(near), "minhash_joined")
    at = (buckets.select("key", "band", "rep", "n").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
          .withColumn("comp", F.coalesce("component", "rep")).drop("component"))
    # one byte of each value: agreement by chance adds 1/256, so nothing near the threshold is lost
    sig8 = F.concat(*[F.expr(f"substring(sig, {4 * k + 1}, 1)") for k in range(2 * PERMS)])
    # the key and the size of the bucket of each band, 0 where the member is alone, as big-endian integers
    entry = F.struct("key", F.least("m", F.lit(2**31 - 1)).cast("int").alias("m"))
    packed = [F.concat(*[F.unhex(F.lpad(F.hex(F.coalesce(F.col("of")[b][c], F.lit(0))), digits, "0")) for b in range(BANDS)])
              for c, digits in (("key", 16), ("m", 8))]
    own = (buckets.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("band", entry))).alias("of"))
           .select("rep", packed[0].alias("keys"), packed[1].alias("sizes")))
    wide = _spread(at).join(classes.select("rep", sig8.alias("sig8")).join(own, "rep"), "rep")
    some = materialize(_maybe(wide, percent), "minhash_maybe")
    few = at.join(some, ["key", "rep"], "left_semi")
    sets = materialize(sets_of(some.select("rep").distinct()), "minhash_rest")
    rest = materialize(_across(_spread(few).join(sets, "rep"), percent), "minhash_rest_links")
    return signed, classes.select("key", "rep", "doc_id", "tag"), near.unionByName(rest)


def _named(classes: DataFrame, found: DataFrame) -> DataFrame:
    """``(key, doc_id, tag)``: for each class, the smallest document of its component."""
    comps = materialize(components(found), "minhash_components")
    of = (classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
          .withColumn("comp", F.coalesce("component", "rep")))
    least = of.groupBy("comp").agg(F.min(F.struct("doc_id", "tag")).alias("least"))
    return materialize(of.select("key", "comp").join(least, "comp").select("key", "least.doc_id", "least.tag"), "minhash_named")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    signed, classes, found = links(id_text(docs, id_col, text_col), width=width, percent=percent)
    named = _named(classes, found).select("key", F.col("doc_id").alias("component_id"))
    linked = signed.where("n > 0 and doc_id is not null").join(named, "key").select("doc_id", "n", "component_id")
    # an id whose other rows have words belongs to the component of these
    alone = signed.where("n = 0 or doc_id is null").select("doc_id", "n")
    shared = alone.where("doc_id is not null").join(
        linked.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "doc_id")
    return (linked.unionByName(shared)
            .unionByName(alone.join(shared.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("component_id", F.col("doc_id")))
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                percent: int = 75) -> DataFrame:
    """One document of each component, all without words and all without an id; columns stay as they are.

    The one that stays has the smallest id; of several texts with this id, the one of smallest digest, once.
    """
    _, classes, found = links(id_text(docs, id_col, text_col), width=width, percent=percent)
    kept = _named(classes, found).select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).distinct()
    own, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    free = own.isNull() | ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    named = docs.join(kept, (own == F.col("__id")) & (F.unhex(F.md5(text)) == F.col("__tag")))
    if named.groupBy("__id", "__tag").count().where("count > 1").limit(1).count():
        named = named.dropDuplicates(["__id", "__tag"])
    return named.drop("__id", "__tag").unionByName(docs.where(free))
