"""Merkle dataset manifest: a tree over the rows of each source and one over the sources.

1. *Leaves*: the digest of a row's fields, by column expressions, in the only
   pass over the texts. Only digests and sort keys are shuffled.
2. *Places*: rows are sorted by range, and a row's place in its tree is its place
   in its partition and the count of the partitions before, so that a source of
   any size is sorted by many tasks.
3. *Partitions of the tree*: aligned runs of ``fanout ** 3`` leaves, each one
   written row, whose subtree is hashed in one task.
4. *Butterfly exchange*: in round r the partitions whose numbers differ in digit
   r only (to the base of the fanout) swap the roots of their aligned groups, and
   each of them hashes the next ancestor for itself. So each partition holds the
   proof up to the root after as many rounds as there are digits, and no pass
   goes down again. The last group of a tree may be short: its partitions answer
   in turn for those that it lacks.
5. The subroots are leaves of one more tree, proved in the same way, and each
   partition folds its own leaves with its proofs.

A run of one node is hashed like any other; a tree of one leaf is that leaf.

Defined cases: a null field is written as ``-``, so it differs from an empty
one. Rows ascend by id, null first, then by leaf; repeated rows are leaves of
their own. A null source is a tree of its own, and the first one. Texts of any
length are hashed whole. An empty table gives no rows, and no root. Columns
other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_rows

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, _LOCAL = 16, 3


def _digest(of: Column) -> Column:
    return F.unhex(F.sha2(of, 256))


def leaf(fields: list[Column]) -> Column:
    """Digest of the fields: ``-`` for null, else byte count, ``:`` and value, one after the other."""
    text = [f.cast("string") for f in fields]
    return _digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]))


def _hash(nodes: list[bytes]) -> bytes:
    """The parent of some nodes: digests go in as lower-case hex text."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def _placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with ``pos``, their place in their ``tree``, from 0, and the ``size`` of the tree."""
    at = F.monotonically_increasing_id()
    spread = (leaves.withColumn("again", at).repartitionByRange("tree", *order, "digest", "again")
              .sortWithinPartitions("tree", *order, "digest", "again").drop("again"))
    rows = materialize(spread.withColumn("m", at).withColumn("part", F.spark_partition_id()), "merkle_sorted")
    per = rows.groupBy("tree", "part").agg(F.min("m").alias("first"), F.count("*").alias("k"))
    # one row for each source of a partition
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("tree", "part", "first", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"),
                      F.sum("k").over(Window.partitionBy("tree")).alias("size"))
    return (rows.join(base, ["tree", "part"]).withColumn("pos", F.col("before") + F.col("m") - F.col("first"))
            .drop("m", "part", "first", "before"))


def _subtree(nodes: list[bytes], fanout: int, whole: bool) -> list[list[bytes]]:
    """Levels of a subtree, leaves first: up to its root, or three levels up if it is part of a larger tree."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= _LOCAL:
        last = levels[-1]
        levels.append([_hash(last[k:k + fanout]) for k in range(0, len(last), fanout)])
    return levels


def _partitions(placed: DataFrame, payload: list[tuple[str, str]], fanout: int) -> tuple[DataFrame, DataFrame]:
    """Of each partition of a tree, one row ``tree, p, parts, rows`` (an array in order), and ``tree, p, parts, root``."""
    run = fanout ** _LOCAL
    names = ["pos", "digest", *(n for n, _ in payload)]
    rows = (placed.withColumn("p", F.floor(F.col("pos") / run)).withColumn("parts", F.ceil(F.col("size") / run))
            .groupBy("tree", "p", "parts").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("rows")))
    types = "array<struct<pos:bigint,digest:binary" + "".join(f",{n}:{t}" for n, t in payload) + ">>"

    def run_(it):
        for batch in it:
            tree, p, parts, digests = (batch.column(k) for k in range(4))
            for k in range(batch.num_rows):
                n = parts[k].as_py()
                root = _subtree(digests[k].as_py(), fanout, n == 1)[-1][0]
                yield tree[k].as_py(), p[k].as_py(), n, root

    rows = materialize(rows.withColumn("rows", F.col("rows").cast(types)), "merkle_rows")
    roots = map_rows(rows.select("tree", "p", "parts", "rows.digest"), run_, [
        ("tree", pa.string(), "string"), ("p", pa.int64(), "long"), ("parts", pa.int64(), "long"), ("root", pa.binary(), "binary")])
    return rows, materialize(roots, "merkle_roots")


def _butterfly(roots: DataFrame, fanout: int) -> DataFrame:
    """``tree, p, root, proof``: the root of the tree, and the siblings above the partition with its own place."""
    state = roots.withColumn("proof", F.array().cast("array<struct<at:int,siblings:array<binary>>>"))
    most = roots.agg(F.coalesce(F.max("parts"), F.lit(0))).collect()[0][0]
    step = 1  # partitions in a group
    while step < most:
        group, digit = F.floor(F.col("p") / step), F.floor(F.col("p") / step) % fanout
        groups = F.ceil(F.col("parts") / step)
        # the last group may be short: its members also answer those that have no partner in it
        held = F.col("parts") - group * step
        asks = F.when(held >= step, F.array(F.col("p") % step)).otherwise(
            F.sequence(F.col("p") % step, F.lit(step - 1).cast("long"), held))
        sent = (state.where(groups > 1).select("tree", F.floor(group / fanout).alias("above"), digit.cast("int").alias("at"),
                                               F.explode(asks).alias("lane"), "root"))
        met = (sent.groupBy("tree", "above", "lane").agg(F.array_sort(F.collect_list(F.struct("at", "root"))).alias("run"))
               .withColumn("parent", _digest(F.lower(F.array_join(F.transform("run", lambda x: F.hex(x["root"])), "")))))
        mine = state.withColumn("above", F.floor(group / fanout)).withColumn("lane", F.col("p") % step)
        others = F.transform(F.filter("run", lambda x: x["at"] != digit), lambda x: x["root"])
        state = materialize(
            mine.join(met, ["tree", "above", "lane"], "left")
            .withColumn("proof", F.when(F.col("run").isNull(), F.col("proof")).otherwise(F.concat("proof", F.array(F.struct(
                digit.cast("int").alias("at"), others.alias("siblings"))))))
            .select("tree", "p", "parts", F.coalesce("parent", "root").alias("root"), "proof"), "merkle_state")
        step *= fanout
    return state


def _proofs(digests: list[bytes], fanout: int, whole: bool) -> Iterator[tuple[int, list[tuple[int, list[bytes]]]]]:
    """Of each leaf of a partition: the siblings on each level of the subtree, with its own place among them."""
    levels = _subtree(digests, fanout, whole)[:-1]
    for k in range(len(digests)):
        out, at = [], k
        for nodes in levels:
            first = at - at % fanout
            out.append((at - first, nodes[first:at] + nodes[at + 1:first + fanout]))
            at //= fanout
        yield k, out


def fold(digest: bytes, proof: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and its siblings, level by level, give."""
    for at, siblings in proof:
        digest = _hash([*siblings[:at], digest, *siblings[at:]])
    return digest


def _levels(proof) -> list[tuple[int, list[bytes]]]:
    return [(x["at"], x["siblings"]) for x in proof]


_PROOF = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.list_(pa.binary()))]))


def _tree_of_trees(subroots: DataFrame, fanout: int) -> DataFrame:
    """``tree, top, root``: the proof of each subroot in the tree over all, and its root."""
    one = subroots.select(F.lit("").alias("tree"), F.col("root").alias("digest"), F.col("tree").alias("name"))
    rows, roots = _partitions(_placed(one, ["name"]), [("name", "string")], fanout)
    upper = _butterfly(roots, fanout).select("tree", "p", "root", "proof")

    def run(it):
        for batch in it:
            for whole, digests, names, root, proof in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, low in _proofs(digests, fanout, whole):
                    yield names[k], [{"at": a, "siblings": s} for a, s in low + _levels(proof)], root

    flat = rows.join(upper, ["tree", "p"]).select(F.col("parts") == 1, "rows.digest", "rows.name", "root", "proof")
    return materialize(map_rows(flat, run, [
        ("tree", pa.string(), "string"), ("top", _PROOF, "array<struct<at:int,siblings:array<binary>>>"),
        ("whole", pa.binary(), "binary")], size=200), "merkle_top")


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source",
             text_col: str = "text", tampered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, digests as lower-case hex.

    ``folded_root`` is what the row as it is now gives with the siblings of the manifest: where ``tampered``,
    its leaf is made anew from a text whose A-Z are in lower case.
    """
    c = lambda name: F.col(f"`{name}`")
    source = c(source_col).cast("string")
    low = F.translate(c(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    now = leaf([low if f == text_col else c(f) for f in fields])
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("+"), source), F.lit("")).alias("tree"),  # the null source sorts first
        c(id_col).cast("long").alias("doc_id"), leaf([c(f) for f in fields]).alias("digest"),
        F.when(F.lit(False) if tampered is None else tampered, now).alias("now"))
    rows, roots = _partitions(_placed(leaves, ["doc_id"]), [("doc_id", "bigint"), ("now", "binary")], fanout)
    upper = _butterfly(roots, fanout)
    top = _tree_of_trees(upper.where("p = 0").select("tree", "root"), fanout)
    proved = (rows.join(upper.select("tree", "p", F.col("root").alias("subroot"), "proof"), ["tree", "p"]).join(top, "tree")
              .select(F.col("parts") == 1, "rows.digest", "rows.doc_id", "rows.now", "subroot", "whole",
                      F.concat("proof", "top").alias("above")))

    def run(it):
        for batch in it:
            for k in range(batch.num_rows):
                one, digests, ids, now_, subroot, root, above = (c[k].as_py() for c in batch.columns)
                above = _levels(above)
                told = "".join(x.hex() for _, s in above for x in s).encode()
                for i, own in _proofs(digests, fanout, one):
                    folded = fold(now_[i] or digests[i], own + above)
                    proof = hashlib.sha256("".join(x.hex() for _, s in own for x in s).encode() + told)
                    yield (ids[i], digests[i].hex(), subroot.hex(), root.hex(), proof.hexdigest(), folded.hex(), folded == root)

    return map_rows(proved, run, [
        ("doc_id", pa.int64(), "long"), ("leaf", pa.string(), "string"), ("subroot", pa.string(), "string"),
        ("root", pa.string(), "string"), ("proof_sha256", pa.string(), "string"), ("folded_root", pa.string(), "string"),
        ("verified", pa.bool_(), "boolean")])
