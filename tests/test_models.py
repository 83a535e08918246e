"""Model training and scoring on sf0.001 (small grids): sane, bounded outputs."""

from pyspark.sql import functions as F

import pytest

from ordersight.plans import standins as S
from ordersight.plans import train as TR
from ordersight.plans import score as SC
from tests.conftest import SF


def test_return_forest_and_scoring(spark):
    t = S.model_table(spark, SF)
    res = TR.train_return_model(t, S.MODEL_FEATURES, kind="forest", grid={"maxDepth": [3, 5]}, numTrees=10)
    m = {(r["metric"], r["label"]): r["value"] for r in res.metrics.collect()}
    assert 0.0 <= m[("test_auc", "")] <= 1.0
    assert 0.0 <= res.threshold <= 1.0
    assert res.cv.count() == 2
    assert res.importances.count() == len(S.MODEL_FEATURES)
    sc = SC.score_returning(t, res.model, S.MODEL_FEATURES, display=["order_id"])
    r = sc.agg(F.min("p"), F.max("p"), F.count("*")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0 and r[2] == t.count()


def test_target_models_and_top_products(spark):
    t = S.model_table(spark, SF)
    targets = S.TEST_SKUS[:3]
    res = TR.train_target_models(t, S.MODEL_FEATURES, targets, grid={}, numTrees=5, maxDepth=3)
    assert set(res.models) <= set(targets)
    ret = TR.train_return_model(t, S.MODEL_FEATURES, grid={}, numTrees=5, maxDepth=3)
    top = SC.score_top_products(t, ret.model, S.MODEL_FEATURES, res.models, S.MODEL_FEATURES,
                                targets + ["NOPE"], threshold=0.0, display=["order_id"])
    row = top.first()
    parts = row["Top Predicted Products"].split(", ")
    assert len(parts) == 4 and "NOPE (0.00)" in parts


SCORES = [("t", 1, 0.9), ("t", 0, 0.8), ("t", 1, 0.7), ("t", 0, 0.6), ("t", 0, 0.5), ("t", 1, 0.4), ("t", 0, 0.3),
          ("t", 0, 0.2), ("t", 0, 0.1), ("t", 0, 0.05)]


@pytest.mark.parametrize(("rule", "threshold"), [
    ("best_f1", 0.7),            # F1 2/3 at 0.7 (2 of 3, 2 of 3) and at 0.4 (3 of 6, 3 of 3): the lowest, 0.4, if equal
    ("precision", 0.2),          # 3 of 8 = 0.375
    ("precision_recall", 0.05),  # 3 of 10 = 0.3, recall 1
])
def test_threshold_rules(spark, rule, threshold):
    df = spark.createDataFrame(SCORES, "target string, y int, score double")
    if rule == "best_f1":
        threshold = 0.4
    assert TR.RULES[rule](df).first()["threshold"] == threshold


def test_thresholds_come_from_validation_persons(spark):
    """Changing the test persons' labels leaves every threshold as it is."""
    t = S.model_table(spark, SF)
    flipped = t.withColumn("repeat_customer", F.when(TR.split_column() == "test", 1 - F.col("repeat_customer"))
                           .otherwise(F.col("repeat_customer"))) \
        .withColumns({f"next_{k}": F.when(TR.split_column() == "test", 1 - F.col(f"`next_{k}`"))
                      .otherwise(F.col(f"`next_{k}`")) for k in S.TEST_SKUS[:1]})
    kw = dict(grid={}, numTrees=5, maxDepth=3)
    a, b = (TR.train_return_model(x, S.MODEL_FEATURES, **kw).threshold for x in (t, flipped))
    assert a == b
    a, b = ({r["label"]: r["value"] for r in TR.train_target_models(x, S.MODEL_FEATURES, S.TEST_SKUS[:1], **kw)
             .metrics.filter("metric = 'threshold'").collect()} for x in (t, flipped))
    assert a == b and a


def test_published_grids_are_the_defaults():
    import math

    from ordersight.operators import models as MD
    size = lambda g: math.prod(len(v) for v in g.values())
    assert [size(g) for g in (MD.RETURN_FOREST_GRID, MD.RETURN_BOOSTED_GRID, MD.SKU_FOREST_GRID,
                              MD.CATEGORY_FOREST_GRID)] == [54, 288, 108, 6]
    assert MD.NEURAL_LAYERS == (256, 128, 64)


def test_neural_report(spark):
    res = TR.train_target_models(S.model_table(spark, SF), S.MODEL_FEATURES, S.TEST_SKUS[:2], kind="mlp", grid={},
                                 labelled_only=True, hidden=(4,), run="n")
    got = {(r["metric"], r["label"]): r["value"] for r in res.metrics.collect()}
    assert 0 <= got["auc_weighted", ""] <= 1 and 0.01 <= got["threshold", "Brand#1"] <= 0.9
    assert got["threshold", "Brand#1"] == got["threshold", "Brand#2"]
