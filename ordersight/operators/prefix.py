"""Ordered prefix aggregates that stay balanced when one key is huge.

A plain ``Window.partitionBy(person).orderBy(t)`` sends every row of a person to
one task. With one person holding a large share of all orders, that task holds a
large share of the data. ``ordered_prefix`` splits each key into time chunks and
computes the same result from three pieces:

1. ``local_prefix``: a window per ``(key, chunk)`` gives the aggregate over the
   earlier rows of the same chunk — the only full shuffle of the rows;
2. ``chunk_summary``: a ``groupBy(key, chunk)`` of the same input (partial
   aggregation before the shuffle, so only one row per chunk and map task
   moves) gives the chunk totals;
3. ``chunk_offsets``: a window per ``key`` over the chunk totals (one row per
   chunk, at most ``time span / bucket`` rows per key) gives the aggregate over
   all earlier chunks. It is joined back on ``(key, chunk)``; the rows keep the
   partitioning of step 1 and only the small chunk table is shuffled.

A chunk that itself holds more than ``instant_threshold`` rows (a date-only export
puts a person's whole day into one second) is cut again: ``with_parts`` deals the
rows of the chunked keys into ranges of ``(key, time, tie)`` by one range shuffle,
and the steps above run on ``(key, chunk, part)``. Parts follow the order, so their
totals are prefixed just as those of the chunks are.

Supported aggregates are the associative ones: ``sum``, ``max``, ``min`` (also
on structs, which gives arg-max / arg-min). The input is evaluated by steps 1
and 2, so pass a cheap plan (a scan and projections) or a checkpointed one.

Chunking costs a chunk table about as large as the rows when keys are small.
With ``hot_threshold`` set, a first partially aggregated count finds the keys
with more rows than that (at most ``max_hot_keys`` of them, so the list is
broadcast with a proven size); only their rows take the chunked path, all
other rows use one plain window per key. If more keys than ``max_hot_keys``
are hot, every row takes the chunked path. Both paths give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}

Agg = tuple[str, str, Column]


def combine(kind: str, a: Column, b: Column) -> Column:
    """Merge two partial aggregates (null = nothing aggregated)."""
    if kind == "sum":
        return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(
            F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    if kind == "max":
        return F.greatest(a, b)
    return F.least(a, b)


def add_chunk(df: DataFrame, time_col: str, bucket: int, chunk_col: str = "_chunk") -> DataFrame:
    if chunk_col in df.columns:
        return df
    return df.withColumn(chunk_col, F.floor(F.col(time_col) / F.lit(bucket)).cast("bigint"))


def local_prefix(work: DataFrame, keys: Sequence[str], order: Sequence[Column],
                 aggs: Sequence[Agg], prefix: str = "_l") -> DataFrame:
    """``{prefix}{name}``: aggregate over the earlier rows of the same ``keys`` group."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return work.withColumns({f"{prefix}{name}": _AGG[kind](e).over(w) for name, kind, e in aggs})


def chunk_summary(work: DataFrame, keys: Sequence[str], aggs: Sequence[Agg],
                  prefix: str = "_t") -> DataFrame:
    """One row per ``keys`` group with ``{prefix}{name}`` totals (partially aggregated)."""
    return work.groupBy(*keys).agg(*[_AGG[kind](e).alias(f"{prefix}{name}") for name, kind, e in aggs])


def chunk_offsets(summary: DataFrame, by: Sequence[str], chunk_cols: Sequence[str], aggs: Sequence[Agg],
                  whole: Sequence[Agg] = (), asc: bool = True) -> DataFrame:
    """``_o{name}`` over earlier chunks and ``_w{name}`` over all chunks of the group."""
    order = [F.col(c).asc() if asc else F.col(c).desc() for c in chunk_cols]
    w_prev = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    w_all = W.partitionBy(*by)
    cols = {f"_o{name}": _AGG[kind](F.col(f"_t{name}")).over(w_prev) for name, kind, _ in aggs}
    cols.update({f"_w{name}": _AGG[kind](F.col(f"_t{name}")).over(w_all) for name, kind, _ in whole})
    return summary.select(*by, *chunk_cols, *[v.alias(k) for k, v in cols.items()])


DEFAULT_HOT_THRESHOLD = 100_000
DEFAULT_MAX_HOT_KEYS = 10_000


def hot_keys(df: DataFrame, by: Sequence[str], threshold: int, max_keys: int):
    """Keys with more than ``threshold`` rows, or ``None`` when more than ``max_keys``
    keys are that hot. One job: partial counts per key, then a bounded top-k."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > threshold)
    rows = counts.orderBy(F.desc("_n")).limit(max_keys + 1).collect()
    if len(rows) > max_keys:
        return None
    return [tuple(r[k] for k in by) for r in rows]


def with_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], threshold: int,
               part_col: str = "_part") -> DataFrame:
    """``part_col``: ranges, ascending in ``order``, of the rows of each ``keys`` group; 0 throughout if no group
    has more than ``threshold`` rows.

    The ranges come from one range shuffle, so they hold about as many rows each, whatever
    the keys; rows that are equal in ``order`` stay together. The result is written, as the
    ranges must be the same for all that read them.
    """
    if hot_keys(df, keys, threshold, 0) is not None:
        return df.withColumn(part_col, F.lit(0))
    ranged = df.repartitionByRange(*keys, *order)
    return materialize(ranged.withColumn(part_col, F.spark_partition_id()), "prefix_parts")


def split_hot(df: DataFrame, by: Sequence[str], keys) -> tuple[DataFrame, DataFrame]:
    """``(light, hot)`` rows by a broadcast list of hot keys (size <= max_hot_keys)."""
    spark = df.sparkSession
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)
    hk = F.broadcast(spark.createDataFrame(keys, schema))
    return df.join(hk, list(by), "left_anti"), df.join(hk, list(by), "left_semi")


def plain_prefix(df: DataFrame, by: Sequence[str], order: Sequence[Column], aggs: Sequence[Agg],
                 whole: Sequence[Agg] = ()) -> DataFrame:
    """The same aggregates with one window per key (for keys of bounded size)."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    wa = W.partitionBy(*by)
    cols = {name: _AGG[kind](e).over(w) for name, kind, e in aggs}
    cols.update({name: _AGG[kind](e).over(wa) for name, kind, e in whole})
    return df.withColumns(cols)


def ordered_prefix(df: DataFrame, by: Sequence[str], time_col: str, tie: Sequence[str],
                   aggs: Sequence[Agg], *, bucket: int = 86400, chunk_col: str = "_chunk",
                   direction: str = "before", whole: Sequence[Agg] = (),
                   null_keys: bool = True, hot_threshold: int | None = None,
                   max_hot_keys: int = DEFAULT_MAX_HOT_KEYS,
                   instant_threshold: int = DEFAULT_HOT_THRESHOLD,
                   hot: tuple[Sequence[str], list] | None = None) -> DataFrame:
    """Add one column per ``(name, kind, expr)`` in ``aggs``: the ``kind`` aggregate
    of ``expr`` over the rows of the same ``by`` group that come strictly before
    (``direction="before"``) or strictly after (``"after"``) the row in
    ``(time_col, *tie)`` order. ``time_col`` is numeric (epoch seconds, a score).

    ``whole`` adds aggregates over the entire group (e.g. the group row count).
    Rows whose ``by`` keys contain a null are not grouped together: they get
    null aggregates (pass ``null_keys=False`` when the caller already removed
    them). A ``chunk_col`` already present is used as given (any grouping that
    is monotone in the order works); it is kept in the output. ``hot = (cols,
    keys)`` gives a hot-key list computed elsewhere over a prefix ``cols`` of
    ``by`` (e.g. hot persons for a ``(person, sku)`` grouping: a pair can only
    be hot if its person is); no detection job for keys then runs here. One that
    finds chunks of more than ``instant_threshold`` rows runs for the chunked keys.
    """
    by, tie = list(by), list(tie)
    df = add_chunk(df, time_col, bucket, chunk_col)
    chunks = [chunk_col, "_part"]
    keys = by + chunks
    null_key = F.lit(False)
    for k in by:
        null_key = null_key | F.col(k).isNull()
    work = df.filter(~null_key) if null_keys else df

    asc = direction == "before"
    order = [F.col(c).asc() if asc else F.col(c).desc() for c in [time_col] + tie]
    light = None
    hot_cols, hk = list(by), None
    if hot is not None:
        hot_cols, hk = list(hot[0]), hot[1]
    elif hot_threshold is not None:
        hk = hot_keys(work, by, hot_threshold, max_hot_keys)
    if hot is not None or hot_threshold is not None:
        if hk is not None and not hk:
            out = plain_prefix(work, by, order, aggs, whole)   # no hot key: one window per key
            return _with_null_keys(out, df, null_key, list(aggs) + list(whole)) if null_keys else out
        if hk is not None:
            light, work = split_hot(work, hot_cols, hk)
            light = plain_prefix(light, by, order, aggs, whole)
    work = with_parts(work, by + [chunk_col], [time_col] + tie, instant_threshold)
    rows = local_prefix(work, keys, order, aggs)
    both = list(aggs) + [(f"w_{n}", k, e) for n, k, e in whole]
    summary = chunk_summary(work, keys, both)
    offs = chunk_offsets(summary, by, chunks, aggs,
                         [(n, k, e) for n, k, e in both if n.startswith("w_")], asc)
    out = rows.join(offs, keys, "inner")
    res = {name: combine(kind, F.col(f"_o{name}"), F.col(f"_l{name}")) for name, kind, _ in aggs}
    res.update({name: F.col(f"_ww_{name}") for name, _, _ in whole})
    tmp = [f"_l{n}" for n, _, _ in aggs] + [f"_o{n}" for n, _, _ in aggs] + \
        [f"_ww_{n}" for n, _, _ in whole] + ["_part"]
    out = out.withColumns(res).drop(*tmp)
    if light is not None:
        out = out.unionByName(light.select(*out.columns))
    if not null_keys:
        return out
    return _with_null_keys(out, df, null_key, list(aggs) + list(whole))


def _with_null_keys(out: DataFrame, df: DataFrame, null_key: Column, aggs: Sequence[Agg]) -> DataFrame:
    nulls = df.filter(null_key)
    return out.unionByName(nulls.withColumns(
        {name: F.lit(None).cast(out.schema[name].dataType) for name, _, _ in aggs}))
