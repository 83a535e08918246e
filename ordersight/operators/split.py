"""Person-level train/test split, leak checks, class and label weights
(M1, P8, P9, A5-A9, U1).

The split is a deterministic hash of the person id, so it needs no driver-side
list of persons, no global sort and no join against an id list: every row can
compute its side locally, and the same person always lands on the same side
whatever the partitioning. Stratification by "person has a positive" holds in
expectation (each stratum is hashed independently with the same rate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

BUCKETS = 10000


def person_bucket(person, seed: int = 42) -> Column:
    """``int(md5(f"{seed}|{person}")[:8], 16) % 10000`` — stable across engines."""
    p = F.col(person) if isinstance(person, str) else person
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), p.cast("string"))), 1, 8)
    return (F.conv(h, 16, 10).cast("bigint") % BUCKETS).cast("int")


def split_side(person, test_fraction: float = 0.2, seed: int = 42) -> Column:
    """``test`` when the person's bucket is below ``test_fraction`` of all buckets."""
    return F.when(person_bucket(person, seed) < int(round(test_fraction * BUCKETS)), "test") \
        .otherwise("train")


def person_split(df: DataFrame, person: str = "person_id", label: str = "repeat_customer",
                 test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """``(person, has_positive, bucket, split)`` — one row per person (M1, A5)."""
    per = df.filter(F.col(person).isNotNull()).groupBy(person).agg(
        F.max((F.col(label) > 0).cast("int")).alias("has_positive"))
    return per.select(person, "has_positive", person_bucket(person, seed).alias("bucket"),
                      split_side(person, test_fraction, seed).alias("split"))


def stratified_split(persons: DataFrame, person: str = "person_id", stratum: str = "has_positive", *,
                     test_percent: int = 20, seed: int = 42) -> DataFrame:
    """``persons`` with ``split``: exactly ``test_percent`` of all persons are in the test, in proportion from each stratum (M1).

    The test has ``ceil(test_percent * n / 100)`` persons; a stratum gives its share rounded down, and the strata
    of largest remainder one more (ties: the smaller stratum). In each stratum they are the persons with the
    smallest hash. A histogram of the hash's buckets tells the bucket that holds the last of them, and only the
    persons of that bucket, one in 10,000, are ranked; so no stratum is sorted in one task.
    """
    rows = materialize(persons.where(F.col(person).isNotNull()).withColumn("_bucket", person_bucket(person, seed)), "persons")
    bins = rows.groupBy(stratum, "_bucket").agg(F.count("*").alias("_n"))
    # one row for each stratum
    sizes = sorted(((r[stratum], r["n"]) for r in bins.groupBy(stratum).agg(F.sum("_n").alias("n")).collect()), key=repr)
    total = sum(n for _, n in sizes)
    quota = -(-total * test_percent // 100)
    taken = [quota * n // total for _, n in sizes]
    for k in sorted(range(len(sizes)), key=lambda k: (-(quota * sizes[k][1] % total), k))[:quota - sum(taken)]:
        taken[k] += 1
    wanted = rows.sparkSession.createDataFrame([(s, t) for (s, _), t in zip(sizes, taken, strict=True)],
                                               T.StructType([T.StructField("_of", rows.schema[stratum].dataType),
                                                             T.StructField("_take", T.LongType())]))
    upto = W.partitionBy(stratum).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)  # 10,000 rows a stratum
    cut = (bins.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
           .join(F.broadcast(wanted), F.col(stratum).eqNullSafe(F.col("_of")))
           .where("_before < _take and _take <= _before + _n")
           .select(F.col(stratum).alias("_stratum"), F.col("_bucket").alias("_cut"), (F.col("_take") - F.col("_before")).alias("_left")))
    at = rows.join(F.broadcast(cut), F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    whole = at.where("_cut is null or _bucket <> _cut").withColumn("split", F.when(F.col("_bucket") < F.col("_cut"), "test").otherwise("train"))
    order = W.partitionBy("_stratum").orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(person).cast("string"))), person)
    last = at.where("_bucket = _cut").withColumn("split", F.when(F.row_number().over(order) <= F.col("_left"), "test").otherwise("train"))
    return whole.unionByName(last).drop("_bucket", "_stratum", "_cut", "_left")


def with_split(df: DataFrame, person: str = "person_id", test_fraction: float = 0.2,
               seed: int = 42) -> DataFrame:
    """Carry the split as a column on every row (P8) — no join needed."""
    return df.withColumn("split", split_side(person, test_fraction, seed))


def leak_check(df: DataFrame, person: str = "person_id") -> DataFrame:
    """Number of persons found on both sides (must be 0)."""
    per = df.groupBy(person).agg(F.countDistinct("split").alias("sides"))
    return per.agg(F.count(F.when(F.col("sides") > 1, 1)).cast("bigint").alias("overlap"))


def split_counts(df: DataFrame, person: str = "person_id", label: str = "repeat_customer") -> DataFrame:
    """Per split: distinct persons and distinct persons with a positive label."""
    per = df.groupBy("split", person).agg(F.max((F.col(label) == 1).cast("int")).alias("pos"))
    return per.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("persons"),
                                    F.sum("pos").cast("bigint").alias("persons_with_positive"))


def class_weights(df: DataFrame, label: str = "repeat_customer") -> DataFrame:
    """Per class: rows, balanced weight ``n / (2 * n_c)`` (A8) and ``neg / pos``."""
    counts = df.groupBy(F.col(label).cast("int").alias("label")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))
    # ``counts`` has one row per class; totals over it are a window on <= 2 rows.
    allw = W.partitionBy()
    total = F.sum("n").over(allw)
    pos = F.sum(F.when(F.col("label") == 1, F.col("n"))).over(allw)
    neg = F.sum(F.when(F.col("label") == 0, F.col("n"))).over(allw)
    return counts.select("label", "n",
                         (total / (F.lit(2.0) * F.col("n"))).alias("balanced_weight"),
                         (neg / pos).alias("scale_pos_weight"))


def labelled_rows(labels: DataFrame, row: str = "order_id") -> DataFrame:
    """Rows with at least one positive label in a long ``(row, sku, y)`` table."""
    return labels.filter(F.col("y") > 0).groupBy(row).agg(
        F.count(F.lit(1)).cast("bigint").alias("positive_labels"))


def label_weights(labels: DataFrame, n_labels: int | None = None) -> DataFrame:
    """Per label: positives and ``total / (labels * max(positives, 1))``.

    ``labels(row, sku, y)``; ``n_labels`` defaults to the number of distinct SKUs.
    """
    per = labels.groupBy("sku").agg(F.sum((F.col("y") > 0).cast("bigint")).alias("positives"))
    # Totals are pre-aggregated to one row and come back as scalar subqueries, so an
    # open-ended catalogue of SKUs never meets in one task.
    k = F.lit(n_labels) if n_labels else per.agg(F.count(F.lit(1))).scalar()
    total = per.agg(F.sum("positives")).scalar()
    return per.select("sku", "positives",
                      (total / (k * F.greatest(F.col("positives"), F.lit(1)))).alias("weight"))
