"""Bundle expansion, SKU whitelist and category presence.

The lookups are left to the planner: a table it knows to be small (such as the
literal ones of ``bundle_table`` and ``category_table``) is broadcast and the item
table is not shuffled; a table that grows with a catalogue is joined by shuffling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lookups import lookup_df


def expand_lines(items: DataFrame, bundles: DataFrame, order: str = "order_id") -> DataFrame:
    """Per item line: a bundle line becomes one line per component with the bundle's
    quantity; other lines pass unchanged."""
    b = bundles.select(F.col("bundle").alias("sku"), "component")
    return items.join(b, "sku", "left").select(
        order, F.coalesce("component", "sku").alias("sku"), "quantity")


def expand_bundles(items: DataFrame, bundles: DataFrame, order: str = "order_id") -> DataFrame:
    """Replace each bundle SKU by its components.

    ``bundles(bundle, component)``. A component's quantity grows by the bundle's
    quantity; the bundle SKU disappears. Result: ``(order, sku, quantity)``
    summed per order and SKU. Bundles and components are disjoint, so one pass
    is enough.
    """
    return (expand_lines(items, bundles, order)
            .groupBy(order, "sku").agg(F.sum("quantity").alias("quantity")))


def bundle_audit(items: DataFrame, bundles: DataFrame) -> DataFrame:
    """Total quantity moved from each bundle to each component."""
    b = bundles.select(F.col("bundle").alias("sku"), "component")
    return (items.join(b, "sku", "inner").groupBy(F.col("sku").alias("bundle"), "component")
            .agg(F.sum("quantity").alias("quantity")))


def keep_skus(items: DataFrame, skus: Sequence[str]) -> DataFrame:
    """Keep only whitelisted SKUs."""
    return items.filter(F.col("sku").isin(list(skus)))


def category_presence(items: DataFrame, categories: DataFrame, order: str = "order_id",
                      qty: str = "quantity") -> DataFrame:
    """``(order, category, present)``: 1 when the SKUs of that category sum to > 0.

    ``categories(sku, category)``; SKUs without a category drop out.
    """
    c = categories.select("sku", "category")
    return (items.join(c, "sku", "inner").groupBy(order, "category")
            .agg((F.sum(qty) > 0).cast("int").alias("present")))


def bundle_table(spark: SparkSession, mapping: dict) -> DataFrame:
    return lookup_df(spark, mapping, "bundle", "component")


def category_table(spark: SparkSession, mapping: dict) -> DataFrame:
    return lookup_df(spark, mapping, "sku", "category")
