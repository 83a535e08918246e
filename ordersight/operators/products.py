"""Product history of a person and next-order labels.

Inputs are the order table and a long ``(order, sku)`` table of products bought
in each order (each product once per order). Everything is a prefix aggregate
over the person's order sequence, computed with ``ordered_prefix`` so that a
person with a huge history is split into time chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import SECONDS_PER_DAY, epoch_seconds
from ..session import materialize as materialize_table

# Fixed value: the count column the source pipeline mistook for a product (trap T1).
COMPAT_PRODUCT = "purchase_count"
from .prefix import DEFAULT_HOT_THRESHOLD, DEFAULT_MAX_HOT_KEYS, hot_keys, ordered_prefix


def _events(orders: DataFrame, order_skus: DataFrame, person: str, ts: str, order: str):
    o = orders.select(person, order, epoch_seconds(ts).alias("_s")).filter(F.col(person).isNotNull())
    ev = o.join(order_skus.select(order, "sku").distinct(), order, "inner")
    return o, ev


def product_history(orders: DataFrame, order_skus: DataFrame, person: str = "person_id",
                    ts: str = "order_datetime", order: str = "order_id", *,
                    bucket: int = SECONDS_PER_DAY, materialize: bool = True,
                    hot_threshold: int | None = DEFAULT_HOT_THRESHOLD,
                    instant_threshold: int = DEFAULT_HOT_THRESHOLD) -> DataFrame:
    """Per order: ``distinct_product_amount`` (W10) and ``most_frequent_product``.

    * W10: number of distinct SKUs bought in the person's earlier orders.
    * W11: SKU bought in the most earlier orders; ties go to the smallest SKU
      text; null when there are no earlier products.

    Method: a running count per (person, sku) gives, for every purchase, how
    many orders so far contained that SKU (1 = first time). Merged into the
    person's order sequence (after their own order), a running sum of
    first-times gives W10 and a running minimum of ``(-count, sku)`` gives W11
    (counts only grow, so the minimum is the current most frequent SKU).
    ``materialize`` writes the narrow running-count table once (under
    ``spark.checkpoint.dir``) so the second pass scans it instead of recomputing
    the first one in each of its branches.
    """
    o, ev = _events(orders, order_skus, person, ts, order)
    # Hot persons are found once, on the narrow orders; both passes use the list
    # (a (person, sku) pair can only be hot if its person is). None: chunk all.
    hot = None
    if hot_threshold is not None:
        hk = hot_keys(o, [person], hot_threshold, DEFAULT_MAX_HOT_KEYS)
        hot = ([person], hk) if hk is not None else None
    ev = ordered_prefix(ev, [person, "sku"], "_s", [order],
                        [("_c", "sum", F.lit(1).cast("bigint"))], bucket=bucket,
                        chunk_col="_chunk_sku", null_keys=False, hot=hot, instant_threshold=instant_threshold)
    ev = ev.select(person, order, "_s", (F.coalesce("_c", F.lit(0)) + 1).alias("_cnt"), "sku",
                   F.lit(1).alias("_kind"))
    if materialize:
        ev = materialize_table(ev, "sku_running_counts")
    seq = o.withColumn("_kind", F.lit(0)).unionByName(ev, allowMissingColumns=True)
    res = ordered_prefix(
        seq, [person], "_s", [order, "_kind"],
        [("_new", "sum", (F.col("_cnt") == 1).cast("bigint")),
         ("_best", "min", F.when(F.col("_kind") == 1,
                                 F.struct((-F.col("_cnt")).alias("neg_count"), F.col("sku"))))],
        bucket=bucket, null_keys=False, hot=hot, instant_threshold=instant_threshold)
    res = res.filter(F.col("_kind") == 0).select(
        order, person,
        F.coalesce(F.col("_new"), F.lit(0)).alias("distinct_product_amount"),
        F.col("_best.sku").alias("most_frequent_product"))
    return res


def next_order(orders: DataFrame, person: str = "person_id", ts: str = "order_datetime",
               order: str = "order_id", *, bucket: int = SECONDS_PER_DAY,
               hot_threshold: int | None = DEFAULT_HOT_THRESHOLD,
               instant_threshold: int = DEFAULT_HOT_THRESHOLD) -> DataFrame:
    """``(order, next_order_id)``: the person's following order (null for the last)."""
    o = orders.select(person, order, epoch_seconds(ts).alias("_s")).filter(F.col(person).isNotNull())
    nxt = ordered_prefix(o, [person], "_s", [order],
                         [("_next", "min", F.struct(F.col("_s"), F.col(order)))],
                         bucket=bucket, direction="after", null_keys=False,
                         hot_threshold=hot_threshold, instant_threshold=instant_threshold)
    return nxt.select(order, person, F.col(f"_next.{order}").alias("next_order_id"))


def next_order_labels(orders: DataFrame, items: DataFrame, person: str = "person_id",
                      ts: str = "order_datetime", order: str = "order_id", *,
                      bucket: int = SECONDS_PER_DAY) -> DataFrame:
    """W14 in long form: ``(order, sku, next_count)`` = quantity of each SKU in the
    person's next order. Orders without a next order have no label rows."""
    nxt = next_order(orders, person, ts, order, bucket=bucket).filter(
        F.col("next_order_id").isNotNull())
    qty = items.groupBy(order, "sku").agg(F.sum("quantity").alias("next_count"))
    qty = qty.withColumnRenamed(order, "next_order_id")
    return nxt.join(qty, "next_order_id", "inner").select(order, person, "sku", "next_count")
