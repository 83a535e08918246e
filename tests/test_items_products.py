"""Item parsing (N1-N3, X19), pivots (A3), bundles (J4, P3, A11), categories (A10)
and product history (W10, W11, W14)."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ordersight.operators import bundles as B
from ordersight.operators import items as I
from ordersight.operators import products as P


def _enc(spark, rows):
    return spark.createDataFrame(rows, "order_id long, line_items string")


def test_parse_rules(spark):
    rows = [(1, "id:1|sku:C8-1000|quantity:1|subtotal:100"),
            (2, "sku:ES3-1000|quantity:2;sku:P4-1000|quantity:1"),
            (3, "sku:C8-1000|quantity:x"),
            (4, None),
            (5, "nokey|sku:Z|sku:C6-1000|quantity:1|note:a:b")]
    it = I.explode_items(_enc(spark, rows), keys=("sku", "quantity", "note"))
    got = sorted((r["order_id"], r["pos"], r["sku"], r["quantity"], r["note"]) for r in it.collect())
    assert got == [(1, 1, "C8-1000", "1", None), (2, 1, "ES3-1000", "2", None),
                   (2, 2, "P4-1000", "1", None), (3, 1, "C8-1000", "x", None),
                   (5, 1, "C6-1000", "1", "a:b")]
    flat = {(r["order_id"], r["pos"]): r for r in I.flatten_items(_enc(spark, rows)).collect()}
    assert flat[(3, 1)]["quantity"] == 0.0          # bad quantity -> 0
    assert flat[(1, 1)]["subtotal"] == 100.0
    assert flat[(2, 1)]["subtotal"] == 0.0          # missing subtotal -> 0


def test_missing_sku_and_wide(spark):
    df = _enc(spark, [(1, "quantity:3;sku:|quantity:1;sku:A|quantity:2")])
    flat = sorted((r["pos"], r["sku"], r["quantity"]) for r in I.flatten_items(df).collect())
    assert flat == [(1, "nan", 3.0), (3, "A", 2.0)]    # no SKU -> "nan"; empty SKU skipped
    w = I.wide_items(df, "line_items", "item", 4, ["sku"]).first()
    assert (w["item_1_sku"], w["item_2_sku"], w["item_3_sku"], w["item_4_sku"]) == (None, "", "A", None)


def test_pivot_conserves_quantity(spark):
    rnd = random.Random(1)
    rows = [(o, f"S{rnd.randint(1, 5)}", float(rnd.randint(1, 4))) for o in range(200) for _ in range(3)]
    items = spark.createDataFrame(rows, "order_id long, sku string, quantity double")
    piv = I.sku_pivot(items, [f"S{i}" for i in range(1, 6)])
    total = piv.select(sum(F.col(f"S{i}_count") for i in range(1, 6)).alias("t")).agg(F.sum("t")).first()[0]
    assert total == sum(r[2] for r in rows)


def test_bundles_grow_components_exactly(spark):
    items = spark.createDataFrame([(1, "ES3-1000", 2.0), (1, "C8-1000", 1.0), (2, "SS2-1000", 1.0),
                                   (2, "X", 5.0)], "order_id long, sku string, quantity double")
    from ordersight.lookups import BUNDLES, SKU_WHITELIST
    bt = B.bundle_table(spark, BUNDLES)
    x = {(r["order_id"], r["sku"]): r["quantity"] for r in B.expand_bundles(items, bt).collect()}
    assert x == {(1, "C8-1000"): 3.0, (1, "P4-1000"): 2.0, (1, "B10-1000"): 2.0,
                 (2, "C8-1000"): 1.0, (2, "P4-1000"): 1.0, (2, "X"): 5.0}
    kept = B.keep_skus(B.expand_bundles(items, bt), SKU_WHITELIST)
    assert {r["sku"] for r in kept.collect()} == {"C8-1000", "P4-1000", "B10-1000"}
    audit = {(r["bundle"], r["component"]): r["quantity"] for r in B.bundle_audit(items, bt).collect()}
    assert audit[("ES3-1000", "B10-1000")] == 2.0 and audit[("SS2-1000", "P4-1000")] == 1.0


def test_category_presence(spark):
    from ordersight.lookups import SKU_CATEGORIES
    items = spark.createDataFrame([(1, "C8-1000", 1.0), (1, "C6-1000", 0.0), (2, "C6-1000", 0.0),
                                   (2, "UNMAPPED", 3.0)], "order_id long, sku string, quantity double")
    got = {(r["order_id"], r["category"]): r["present"] for r in
           B.category_presence(items, B.category_table(spark, SKU_CATEGORIES)).collect()}
    assert got == {(1, "Chef Knife"): 1, (2, "Chef Knife"): 0}


def _brute_products(orders, skus):
    by = {}
    for p, o, t in orders:
        by.setdefault(p, []).append((t, o))
    out = {}
    for p, lst in by.items():
        lst.sort()
        seen = Counter()
        for t, o in lst:
            if seen:
                best = min(seen.items(), key=lambda kv: (-kv[1], kv[0]))[0]
            else:
                best = None
            out[o] = (len(seen), best)
            for s in skus.get(o, ()):
                seen[s] += 1
    return out


@pytest.mark.parametrize("bucket,hot", [(86400, None), (3600, None), (86400, 40), (86400, 10**9)])
def test_product_history_brute_force(spark, bucket, hot):
    """hot=None: all chunked; 40: the big person chunked, others plain; 10**9: all plain."""
    rnd = random.Random(3)
    orders, skus, oid = [], {}, 0
    for p in range(12):
        for _ in range(120 if p == 0 else rnd.randint(1, 15)):
            oid += 1
            orders.append((f"p{p}", oid, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randint(0, 2000))))
            skus[oid] = set(rnd.sample(["A", "B", "C", "D", "b"], rnd.randint(0, 3)))
    o = spark.createDataFrame(orders, "person_id string, order_id long, order_datetime timestamp_ntz")
    os_ = spark.createDataFrame([(k, s) for k, v in skus.items() for s in v], "order_id long, sku string")
    got = {r["order_id"]: (r["distinct_product_amount"], r["most_frequent_product"])
           for r in P.product_history(o, os_, bucket=bucket, hot_threshold=hot).collect()}
    assert got == _brute_products(orders, skus)


@pytest.mark.parametrize("hot", [None, 40])
def test_products_of_orders_that_share_a_second(spark, hot):
    rnd = random.Random(11)
    orders = [("p0" if i < 250 else f"p{i % 9}", i, dt.datetime(2024, 1, 1, 8)) for i in range(320)]
    skus = {o: set(rnd.sample(["A", "B", "C", "D", "b"], rnd.randint(0, 3))) for _, o, _ in orders}
    rnd.shuffle(orders)
    o = spark.createDataFrame(orders, "person_id string, order_id long, order_datetime timestamp_ntz")
    os_ = spark.createDataFrame([(k, s) for k, v in skus.items() for s in v], "order_id long, sku string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["order_id"]: (r["distinct_product_amount"], r["most_frequent_product"])
               for r in P.product_history(o, os_, hot_threshold=hot, instant_threshold=30).collect()}
        follow = {r["order_id"]: r["next_order_id"]
                  for r in P.next_order(o, hot_threshold=hot, instant_threshold=30).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == _brute_products(orders, skus)
    by = {}
    for p, oid, _ in sorted(orders):
        by.setdefault(p, []).append(oid)
    assert follow == {a: b for lst in by.values() for a, b in zip(lst, lst[1:] + [None], strict=True)}


def test_next_order_labels(spark):
    o = spark.createDataFrame([("a", 1, dt.datetime(2024, 1, 1)), ("a", 2, dt.datetime(2024, 1, 5)),
                               ("a", 3, dt.datetime(2024, 1, 5)), ("b", 4, dt.datetime(2024, 1, 1))],
                              "person_id string, order_id long, order_datetime timestamp_ntz")
    items = spark.createDataFrame([(2, "X", 1.0), (2, "X", 2.0), (3, "Y", 1.0), (4, "Z", 1.0)],
                                  "order_id long, sku string, quantity double")
    got = sorted((r["order_id"], r["sku"], r["next_count"]) for r in P.next_order_labels(o, items).collect())
    assert got == [(1, "X", 3.0), (2, "Y", 1.0)]


def test_compat_product_history(spark):
    """With the pseudo-product of every named order, W10 is one higher after the
    first order and W11 is that pseudo-product unless a SKU is in every earlier order."""
    o = spark.createDataFrame([("a", 1, dt.datetime(2024, 1, 1)), ("a", 2, dt.datetime(2024, 1, 2)),
                               ("a", 3, dt.datetime(2024, 1, 3))],
                              "person_id string, order_id long, order_datetime timestamp_ntz")
    real = spark.createDataFrame([(1, "C8-1000"), (2, "P4-1000")], "order_id long, sku string")
    pseudo = spark.createDataFrame([(i, P.COMPAT_PRODUCT) for i in (1, 2, 3)], "order_id long, sku string")
    got = {r["order_id"]: (r["distinct_product_amount"], r["most_frequent_product"])
           for r in P.product_history(o, real.unionByName(pseudo)).collect()}
    assert got == {1: (0, None), 2: (2, "C8-1000"), 3: (3, P.COMPAT_PRODUCT)}


@pytest.mark.parametrize("hot", [None, 30, 10**9])
def test_next_order_all_paths(spark, hot):
    rnd = random.Random(4)
    rows, oid = [], 0
    for p in range(8):
        for _ in range(100 if p == 0 else rnd.randint(1, 10)):
            oid += 1
            rows.append((f"p{p}", oid, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randint(0, 3000))))
    o = spark.createDataFrame(rows, "person_id string, order_id long, order_datetime timestamp_ntz")
    got = {r["order_id"]: r["next_order_id"] for r in P.next_order(o, hot_threshold=hot).collect()}
    exp = {}
    for p in {r[0] for r in rows}:
        seq = sorted((r[2], r[1]) for r in rows if r[0] == p)
        for i, (_, o_) in enumerate(seq):
            exp[o_] = seq[i + 1][1] if i + 1 < len(seq) else None
    assert got == exp
