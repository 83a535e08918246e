"""Jobs that take every SKU of the data, not a list of them."""

import pytest
from pyspark.sql import functions as F

BRANDS = [f"Brand#{i}" for i in range(3, 12)] + ["Brand#31", "Brand#52"]  # of which two are not stand-in SKUs


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """300 orders of 30 persons; each order has two lines, and a person's next order depends on the last."""
    d = str(tmp_path_factory.mktemp("shop"))
    i = F.col("id")
    spark.range(len(BRANDS)).select(
        i.alias("p_partkey"), F.element_at(F.array(*map(F.lit, BRANDS)), (i + 1).cast("int")).alias("p_brand"),
        F.concat(F.lit("part "), i.cast("string")).alias("p_name")).write.parquet(f"{d}/part.parquet")
    spark.range(300).select(
        i.alias("o_orderkey"), (i % 30).alias("o_custkey"), F.expr("date_add(date'2020-01-01', cast(id as int))").alias("o_orderdate"),
        (i * 37 % 101 + 0.5).cast("double").alias("o_totalprice")).write.parquet(f"{d}/orders.parquet")
    spark.range(600).select(
        F.expr("id div 2").alias("l_orderkey"), (i % 2 + 1).cast("int").alias("l_linenumber"),
        F.expr(f"(id div 60 + id * id) % {len(BRANDS)}").alias("l_partkey"), F.lit(1.0).alias("l_quantity"),
        (i % 50 + 1).cast("double").alias("l_extendedprice")).write.parquet(f"{d}/lineitem.parquet")
    return d


def test_model_table_has_every_sku(spark, shop):
    """Brands outside the stand-in list have their counts and labels; by default the columns are those of the list."""
    from ordersight.plans import standins as S
    skus = S.all_skus(spark, shop)
    assert skus == [*S.TEST_SKUS, "Brand#31", "Brand#52"]
    t = S.model_table(spark, shop, skus)
    bought = t.agg(*[F.sum(F.col(f"`{s}_count`")).alias(s) for s in skus]).first()
    assert sum(bought) == 600 and bought["Brand#31"] > 0
    assert t.agg(F.sum("`next_Brand#52`")).first()[0] > 0
    assert not [c for c in S.model_table(spark, shop).columns if "31" in c]


def test_top_products_are_of_all_skus(spark, shop, monkeypatch):
    """every SKU of the data is a candidate."""
    from ordersight.plans import catalog as C
    seen, score = [], C.SC.score_top_products
    monkeypatch.setattr(C.SC, "score_top_products", lambda *a, **k: seen.append(a) or score(*a, **k))
    rows = C.QUERIES["score_top_products"](spark, shop).collect()
    named = {t.split(" (")[0] for r in rows for t in r["Top Predicted Products"].split(", ")}
    assert rows and named & {"Brand#8", "Brand#9", "Brand#10", "Brand#11", "Brand#31", "Brand#52"}
    models, targets = seen[0][3], seen[0][5]
    assert set(BRANDS) <= set(targets) and set(models) == set(BRANDS)
    assert {f"{s}_count" for s in BRANDS} <= set(seen[0][2])


def test_network_has_all_labels(spark, shop):
    """the network learns a label for every SKU of the data, from all rows that have one."""
    from ordersight.plans import catalog as C
    out = C.QUERIES["train_next_neural"](spark, shop).collect()
    assert {r["label"] for r in out if r["metric"] == "threshold"} >= set(BRANDS)
    assert next(r["value"] for r in out if r["metric"] == "models") == len(BRANDS)
