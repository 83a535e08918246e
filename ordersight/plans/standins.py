"""Reference-shaped inputs built from the driver's test tables.

The library works on web-shop order exports (one row per order, encoded line
items, free-text contact fields). The test data is a TPC-H style star schema, so
these builders only *rename and render* test rows into that shape; they do none
of the work of the operators. Each builder has a DuckDB twin in
``ordersight.plans.oracle`` so that the catalogue can be checked end to end.

Mapping: person = ``o_custkey``, order = ``o_orderkey``, order time =
``o_orderdate``, order total = ``o_totalprice``, SKU = ``p_brand`` of the line's
part, quantity = ``l_quantity``, subtotal = ``l_extendedprice``; contact text is
rendered from ``customer`` keys; census rows come from ``nation``; the name table
from ``part``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person_id, order_id, order_datetime, order_total) from ``orders``."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("person_id"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("order_datetime"),
        F.col("o_totalprice").alias("order_total"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with its SKU: (order_id, line_no, sku, name, quantity, subtotal)."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    return li.join(part, li.l_partkey == part.p_partkey, "inner").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_key"),
        F.col("p_brand").alias("sku"),
        F.col("p_name").alias("name"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("subtotal"),
    )


def _line_text(line: F.Column) -> F.Column:
    # Rendered like a shop export: key:value fields joined by '|'. Some lines get
    # a field without ':' and a repeated sku key, some a non-numeric quantity.
    qty = F.when(line["part_key"] % 13 == 0, F.lit("x")).otherwise(
        line["quantity"].cast("bigint").cast("string"))
    return F.concat(
        F.lit("id:"), line["line_no"].cast("string"),
        F.lit("|name:"), line["name"],
        F.when(line["part_key"] % 11 == 0, F.lit("|sku:OLD")).otherwise(F.lit("")),
        F.lit("|sku:"), line["sku"],
        F.lit("|quantity:"), qty,
        F.lit("|subtotal:"), F.format_string("%.2f", line["subtotal"]),
        F.when(line["line_no"] == 3, F.lit("|junk")).otherwise(F.lit("")),
    )


def encoded_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with a ``line_items`` text column (null when the order has no lines)."""
    # The text of a line is rendered after the shuffle, which carries its values only.
    lines = order_lines(spark, sf_dir).groupBy("order_id").agg(
        F.collect_list(F.struct("line_no", "part_key", "quantity", "subtotal", "sku", "name")).alias("_lines"))
    rendered = lines.select("order_id", F.transform("_lines", lambda x: F.struct(
        x["line_no"].alias("line_no"), x["part_key"].alias("part_key"), x["quantity"].alias("quantity"),
        x["subtotal"].alias("subtotal"), _line_text(x).alias("_txt"))).alias("_lines"))
    enc = rendered.select("order_id", F.array_join(F.transform(F.array_sort("_lines"), lambda x: x["_txt"]), ";")
                          .alias("line_items"))
    orders = history_orders(spark, sf_dir)
    return orders.join(enc, "order_id", "left")


# Stand-in lookups for the test catalogue, where SKUs are part brands. They play
# the role of the shop's bundle map, whitelist and category map.
TEST_SKUS = [f"Brand#{i}" for i in range(1, 26)]
TEST_BUNDLES = {
    "Brand#21": ["Brand#1", "Brand#2"],
    "Brand#22": ["Brand#3", "Brand#4", "Brand#5"],
    "Brand#23": ["Brand#6"],
    "Brand#24": ["Brand#1", "Brand#7"],
}
TEST_WHITELIST = [f"Brand#{i}" for i in range(1, 21)] + ["nan"]
TEST_CATEGORY_NAMES = ["Chef", "Specialty", "Honing", "Sheath"]
TEST_CATEGORIES = {f"Brand#{i}": TEST_CATEGORY_NAMES[i % 4] for i in range(1, 21)}


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long ``(order_id, sku, quantity, subtotal)`` straight from the line items."""
    return order_lines(spark, sf_dir).select("order_id", "sku", "quantity", "subtotal")


def _s(c) -> F.Column:
    return c.cast("string")


def _lp(c, n: int) -> F.Column:
    return F.lpad(c.cast("string"), n, "0")


def _case(key: F.Column, values: list) -> F.Column:
    """CASE key WHEN 0 THEN values[0] WHEN 1 ... (rendering helper)."""
    expr = None
    for i, v in enumerate(values):
        v = v if isinstance(v, F.Column) else F.lit(v)
        expr = F.when(key == i, v) if expr is None else expr.when(key == i, v)
    return expr


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with shop-style contact text rendered from its keys.

    First names are part names (so they meet the name table); case, padding and
    missing values vary with the key so that every cleaning rule is exercised.
    """
    c = table(spark, sf_dir, "customer")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    k, n, seg = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment")
    # names come from the whole part table: keys 0 to its size
    j = c.join(p, (k * 7 % p.count()) == p.p_partkey, "inner")
    zp = _lp(n * 1000 + k % 3, 5)
    pn = F.col("p_name")

    def company(key):
        return _case(key % 8, [F.lit(None).cast("string"), "   ", "Retired", "Guest", "Self Employed",
                               "Title (optional)", "Unknown", F.concat(seg, F.lit(" Inc"))])

    return j.select(
        k.alias("c_custkey"),
        F.when(k % 41 == 7, F.lit(None).cast("string")).otherwise(
            _case(k % 3, [F.upper(pn), F.concat(F.lit(" "), pn, F.lit(" ")), pn])
        ).alias("billing_first_name"),
        F.concat(F.lit("Last"), _s(k % 500)).alias("billing_last_name"),
        F.when(k % 53 == 3, F.lit(None).cast("string")).otherwise(_case(k % 4, [
            F.concat(zp, F.lit("-"), _lp(k % 10000, 4)),
            F.concat(F.lit(" "), zp, F.lit("-12")),
            zp,
            F.concat(zp, F.lit("-123456"))])).alias("billing_postcode"),
        _case(k % 5, [
            F.concat(_lp(k % 1000, 3), F.lit("-555-"), _lp(k % 10000, 4)),
            F.concat(F.lit("1 ("), _lp(k % 1000, 3), F.lit(") 555 "), _lp(k % 10000, 4)),
            F.concat(F.lit("abc"), _s(k)),
            F.lit(None).cast("string"),
            F.concat(F.lit("+44 20 "), _s(k))]).alias("billing_phone"),
        _case(k % 6, [
            F.concat(F.lit("u"), _s(k), F.lit("@gmail.com")),
            F.concat(F.lit("u"), _s(k), F.lit("@school.edu")),
            F.concat(F.lit("u"), _s(k), F.lit("@"), F.lower(seg), F.lit(".com")),
            F.concat(F.lit("u"), _s(k), F.lit("@mail.de")),
            F.lit(None).cast("string"),
            F.concat(F.lit("u"), _s(k), F.lit(".example.org"))]).alias("billing_email"),
        company(k).alias("billing_company"),
        company(k + 3).alias("shipping_company"),
        _case(n % 6, ["Oregon", " new york ", "CA", F.lit(None).cast("string"),
                      "District of Columbia", "Ontario"]).alias("billing_state"),
        F.concat(F.lit("City"), _s(n % 10)).alias("billing_city"),
        F.when(k % 9 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("City"), _s((n + k) % 10))).alias("shipping_city"),
        _case(k % 4, [F.concat(F.lit("id:"), _s(k), F.lit("|code:c")), "id:|code:x",
                      F.lit(None).cast("string"), "code:y"]).alias("coupon_items"),
    )


def item_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipping and coupon lists per order, rendered from ``orders``: none, one or two items, keys that repeat, text
    without a key, values with a colon or none."""
    k, st = F.col("o_orderkey"), F.col("o_orderstatus")
    ship = F.concat(F.lit("id:"), _s(k), F.lit("|method_id:"), _case(k % 3, ["flat_rate", "free", "zone:4"]),
                    F.lit("|total:"), F.format_string("%.2f", F.col("o_totalprice")))
    second = F.concat(F.lit(";id:"), _s(k + 1), F.lit("|note|total:|status:"), st, F.lit("|status:last"))
    return table(spark, sf_dir, "orders").select(
        k.alias("order_id"),
        F.when(k % 7 != 0, F.concat(ship, F.when(k % 5 == 0, second).otherwise(""))).alias("shipping_items"),
        _case(k % 4, [F.concat(F.lit("id:"), _s(k), F.lit("|code:c"), _s(k % 10)), F.lit(None).cast("string"), "",
                      F.concat(F.lit("code:a;code:b|amount:"), _s(k % 100))]).alias("coupon_items"))


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One census row per nation zip, with survey-style text incomes and margins."""
    n = F.col("n_nationkey")
    nat = table(spark, sf_dir, "nation")
    return nat.select(
        _lp(n * 1000, 5).alias("zip"),
        _case(n % 5, ["250,000+", "2,500-", "-", _s(n * 1234 + 40000), "(X)"])
        .alias("median_household_income"),
        _case(n % 5, ["***", "**", "N", _s(n + 1000), "1,234"]).alias("moe_median_household_income"),
        _case(n % 4, ["N", "80,500", _s(n * 321 + 50000), _s(n * 321 + 50000)])
        .alias("mean_household_income"),
        _case(n % 4, ["***", "-", _s(n + 2000), _s(n + 2000)]).alias("moe_mean_household_income"),
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first-name gender table (Name, Gender, Probability) rendered from ``part``."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        _case(k % 3, [F.concat(F.lit(" "), F.upper("p_name")), F.col("p_name"),
                      F.concat(F.col("p_name"), F.lit(" "))]).alias("Name"),
        F.when(F.col("p_size") % 2 == 0, "M").otherwise("F").alias("Gender"),
        (F.col("p_size").cast("double") / 50.0).alias("Probability"),
    )


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pooled prediction table ``(target, y, score)`` from the line items.

    ``target`` = line status, ``y`` = returned line, ``score`` = a tied, bounded
    number built from discount and tax. It stands in for model scores.
    """
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_linestatus").alias("target"),
                     F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
                     (F.col("l_discount") * 5 + F.col("l_tax")).alias("score"))


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shop order export (one row per order) rendered from orders, customers and lines.

    The order time gets hours, minutes and seconds from the order key; contact
    text comes from :func:`contacts`; ``line_items`` from :func:`encoded_orders`.
    """
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    date = F.concat(F.date_format(F.col("o_orderdate"), "yyyy-MM-dd"), F.lit(" "),
                    _lp(k % 24, 2), F.lit(":"), _lp(k % 60, 2), F.lit(":"), _lp(k % 7, 2))
    base = o.select(
        k.alias("order_id"), F.col("o_custkey").alias("c_custkey"),
        _s(F.col("o_custkey")).alias("customer_id"), F.col("o_orderstatus").alias("status"),
        date.alias("date"), F.col("o_totalprice").alias("order_total"),
        _case(k % 3, ["USD", "USD", "CAD"]).alias("order_currency"),
        _case(k % 4, ["card", "paypal", "card", "bank"]).alias("payment_method"),
        F.substring(F.col("o_orderpriority"), 3, 100).alias("shipping_method"),
        F.lit("US").alias("billing_country"), F.lit("US").alias("shipping_country"))
    enc = encoded_orders(spark, sf_dir).select("order_id", "line_items")
    c = contacts(spark, sf_dir)
    out = base.join(c, "c_custkey", "inner").join(enc, "order_id", "left")
    return out.withColumns({"shipping_postcode": F.col("billing_postcode"),
                            "shipping_state": F.col("billing_state")}).drop("c_custkey")


def all_skus(spark: SparkSession, sf_dir: str) -> list[str]:
    """Every SKU of the part table: the stand-in ones in their order, then the others by name."""
    found = {r["p_brand"] for r in table(spark, sf_dir, "part").select("p_brand").where("p_brand is not null").distinct().collect()}
    return TEST_SKUS + sorted(found - set(TEST_SKUS))


def model_table(spark: SparkSession, sf_dir: str, skus: Sequence[str] | None = None) -> DataFrame:
    """Per-order training table: history features, SKU counts of the order, the
    return label and ``next_{sku}`` / ``next_{category}`` labels (0/1).

    Built with the library operators (history windows, pivots, next-order labels).
    ``skus``: those with a count and a label, the stand-in ones by default.
    """
    skus = TEST_SKUS if skus is None else skus
    from ..operators import bundles as B
    from ..operators import history as H
    from ..operators import items as I
    from ..operators import products as P

    orders = history_orders(spark, sf_dir)
    items = order_items(spark, sf_dir)
    hist = H.history_features(orders)
    counts = I.sku_pivot(items, skus, "quantity", suffix="_count")
    lab = P.next_order_labels(orders, items)
    nxt = lab.select("order_id", "sku", (F.col("next_count") > 0).cast("int").alias("y"))
    sku_lab = I.sku_pivot(nxt.withColumn("quantity", F.col("y")), skus, "quantity", suffix="")
    sku_lab = sku_lab.select("order_id", *[F.col(f"`{s}`").alias(f"next_{s}") for s in skus])
    cat = B.category_presence(nxt.withColumnRenamed("y", "quantity"),
                              B.category_table(spark, TEST_CATEGORIES))
    cat_lab = cat.groupBy("order_id").pivot("category", TEST_CATEGORY_NAMES).agg(F.max("present"))
    cat_lab = cat_lab.select("order_id", *[F.col(c).alias(f"next_{c}") for c in TEST_CATEGORY_NAMES])
    out = hist.join(counts, "order_id", "left").join(sku_lab, "order_id", "left") \
        .join(cat_lab, "order_id", "left")
    fill = [f"{s}_count" for s in skus] + [f"next_{s}" for s in skus] + \
        [f"next_{c}" for c in TEST_CATEGORY_NAMES]
    return out.na.fill(0, subset=fill)


def model_features(skus: Sequence[str]) -> list[str]:
    """The features of :func:`model_table` with these SKUs."""
    return ["order_total", "time_since_last_purchase", "time_between_purchases",
            "time_since_first_purchase", "number_of_past_orders", "order_frequency_90_days",
            "average_order_value", "total_order_value", "std_order_value"] + [f"{s}_count" for s in skus]


MODEL_FEATURES = model_features(TEST_SKUS)
