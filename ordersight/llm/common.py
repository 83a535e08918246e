"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id long, text string)``: other columns, whatever their names, stay out of the way."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                     F.col(f"`{text_col}`").cast("string").alias("text"))


def texts(column: pa.Array, step: int = 256) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, null as empty; a few rows at a time, as texts may be long."""
    for at in range(0, len(column), step):
        for x in column.slice(at, step).cast(pa.binary()).to_pylist():
            yield b"" if x is None else x


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a URI and the path in it; a scheme that Arrow doesn't know raises."""
    return fs.FileSystem.from_uri(f"s3{uri[3:]}" if uri.startswith("s3a:") else uri)


def batches(schema: pa.Schema, rows: Iterator[tuple], size: int = 5000) -> Iterator[pa.RecordBatch]:
    """Tuples into record batches of at most ``size`` rows."""
    buffer = []
    for row in rows:
        buffer.append(row)
        if len(buffer) >= size:
            yield _batch(schema, buffer)
            buffer = []
    if buffer:
        yield _batch(schema, buffer)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def releasing(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end Arrow gives the memory it holds in reserve back to the system.

    A Python worker serves task after task of other jobs, and would keep what the largest batches of all took.
    """
    try:
        yield from it
    finally:
        pa.default_memory_pool().release_unused()


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]],
             schema: list[tuple[str, pa.DataType, str]], size: int = 5000) -> DataFrame:
    """``mapInArrow`` with a generator of tuples; ``schema``: (name, Arrow type, Spark type)."""
    arrow = pa.schema([(n, t) for n, t, _ in schema])

    def run(it):
        yield from releasing(batches(arrow, fn(it), size))

    return df.mapInArrow(run, ", ".join(f"{n} {s}" for n, _, s in schema))


def foremost(df: DataFrame, n: int, *bins: Column) -> DataFrame:
    """Rows that hold the first ``n`` by ``bins``, and few others.

    Each of ``bins`` is an ascending integer of a few thousand values, the next one parting the rows of one
    value of the last. The rows of each bin are counted (only these counts reach the driver), so that an
    ``orderBy`` and ``limit`` after it get about ``n`` rows in all, where they would get ``n`` of each partition.
    """
    whole, rest = [], df
    for b in bins:
        sure, cut = n, None
        for r in sorted(rest.groupBy(b.cast("long").alias("b")).agg(F.count("*").alias("k")).collect()):
            if r.k >= sure:
                cut = r.b
                break
            sure -= r.k
        if cut is None:
            break
        whole.append(rest.where(b < cut))
        rest, n = rest.where(b == cut), sure
    return functools.reduce(DataFrame.unionByName, [*whole, rest])


def with_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id is in ``ids.doc_id``; every column of ``df`` is kept as it is."""
    key = "__llm_id"
    return df.join(ids.select(F.col("doc_id").alias(key)), F.col(f"`{id_col}`") == F.col(key), "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id is not in ``ids.doc_id``; rows with a null id stay."""
    key = "__llm_id"
    return df.join(ids.select(F.col("doc_id").alias(key)), F.col(f"`{id_col}`") == F.col(key), "left_anti")
