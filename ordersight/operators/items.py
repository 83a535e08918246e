"""Item lists: parse, flatten, pivot.

Items are kept in *long* form ``(order, sku, quantity, subtotal)``; the wide
``{sku}_count`` matrix is only built at the edge with a given SKU list (no
extra job to discover the values, no unbounded column count).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.items import field, records, slot_field, to_number

MISSING_SKU = "nan"  # fixed value: text of an item without SKU


def explode_items(df: DataFrame, text: str = "line_items", order: str = "order_id",
                  keys: Sequence[str] = ("sku", "quantity", "subtotal")) -> DataFrame:
    """One row per encoded item: ``(order, pos, *keys)`` with raw text values.

    ``pos`` is 1-based. Orders with a null or empty list have no rows.
    """
    exploded = df.select(order, F.posexplode(records(text)).alias("_pos", "_rec"))
    return exploded.select(order, (F.col("_pos") + 1).alias("pos"),
                           *[field("_rec", k).alias(k) for k in keys])


def flatten_items(df: DataFrame, text: str = "line_items", order: str = "order_id") -> DataFrame:
    """``(order, pos, sku, quantity, subtotal)`` with numbers coerced.

    Quantity and subtotal that do not parse become 0; an item without SKU gets
    the SKU ``nan``; items whose SKU is empty text are skipped.
    """
    items = explode_items(df, text, order)
    return items.select(
        order, "pos",
        F.coalesce(F.col("sku"), F.lit(MISSING_SKU)).alias("sku"),
        to_number("quantity").alias("quantity"),
        to_number("subtotal").alias("subtotal"),
    ).filter(F.col("sku") != "")


def item_fields(df: DataFrame, text: str, order: str = "order_id") -> DataFrame:
    """``(order, slot, key, value)`` of every field of every item of an encoded list.

    Works for line, shipping and coupon lists alike, over all their slots and keys.
    A field without ``:`` is ignored; of a key that repeats in an item the last
    value wins. An item's fields are settled inside its row, without a shuffle: all of
    them are exploded with their place in the item, and one whose key comes again in
    the keys after that place is dropped.
    """
    slots = df.select(order, F.posexplode(records(text)).alias("_pos", "_rec"))
    # Columns of their own: inside a lambda they would be computed again for every field.
    split = slots.select(order, (F.col("_pos") + 1).alias("slot"),
                         F.filter(F.split("_rec", "[|]"), lambda t: F.instr(t, ":") > 0).alias("_fields"))
    keyed = split.select(order, "slot", "_fields", F.transform("_fields", lambda t: F.substring_index(t, ":", 1)).alias("_keys"))
    fields = keyed.select(order, "slot", "_keys", F.posexplode("_fields").alias("_i", "_f"))
    key = F.get("_keys", F.col("_i"))
    again = F.array_contains(F.slice("_keys", F.col("_i") + 2, F.size("_keys")), key)
    return fields.where(~again).select(order, "slot", key.alias("key"),
                                       F.substring(F.col("_f"), F.length(key) + 2, F.length("_f")).alias("value"))


def wide_items(df: DataFrame, text: str, prefix: str, slots: int,
               keys: Sequence[str]) -> DataFrame:
    """``{prefix}_{i}_{key}`` columns for slots 1..``slots`` (N2), only those asked for."""
    cols = {f"{prefix}_{i}_{k}": slot_field(text, i, k)
            for i in range(1, slots + 1) for k in keys}
    return df.withColumns(cols)


def sku_pivot(items: DataFrame, skus: Sequence[str], value: str = "quantity",
              order: str = "order_id", suffix: str = "_count") -> DataFrame:
    """One row per order, one ``{sku}{suffix}`` column per given SKU: sum of ``value`` (A3/A4).

    SKUs outside the list are ignored; absent ones are 0. Written as one
    conditional aggregation by order (partial sums before the shuffle), which
    is what a pivot with a given value list amounts to, in a single shuffle.
    """
    sku = F.col("sku")
    v = F.col(value).cast("double")
    return items.groupBy(order).agg(*[
        F.coalesce(F.sum(F.when(sku == F.lit(s), v)), F.lit(0.0)).alias(f"{s}{suffix}") for s in skus])


def attach_pivot(orders: DataFrame, pivot: DataFrame, order: str = "order_id") -> DataFrame:
    """Left-join a per-order pivot back to the orders; orders without items get zeros."""
    cols = [c for c in pivot.columns if c != order]
    return orders.join(pivot, order, "left").na.fill(0, subset=cols)


def drop_suffix(df: DataFrame, suffix: str = "_subtotal") -> DataFrame:
    """Drop every column whose name ends with ``suffix``."""
    return df.select([F.col(f"`{c}`") for c in df.columns if not c.endswith(suffix)])


def order_skus(items: DataFrame, order: str = "order_id") -> DataFrame:
    """Distinct ``(order, sku)`` pairs with a positive quantity."""
    return (items.groupBy(order, "sku").agg(F.sum("quantity").alias("quantity"))
            .filter(F.col("quantity") > 0))
