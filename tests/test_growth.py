"""Work that grows no faster than the input: what a plan computes once, stores narrow, or runs side by side."""

from pyspark.sql import functions as F

from ordersight.operators import items as I
from tests.conftest import SF


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_items_are_split_once(spark):
    """An item's fields are split once, not again for every field; the last of a repeated key wins."""
    df = spark.createDataFrame([(1, "a:1|junk|b:x:y|a:2;c:|a:3|c:4|c:5"), (2, None), (3, "")], "order_id long, t string")
    out = I.item_fields(df, "t")
    assert _plan(out).count("[|]") <= 2  # in the projection and in the filter before it
    got = sorted((r.order_id, r.slot, r.key, r.value) for r in out.collect())
    assert got == [(1, 1, "a", "2"), (1, 1, "b", "x:y"), (1, 2, "a", "3"), (1, 2, "c", "5")]


def test_line_text_is_not_shuffled(spark):
    """The shuffle of the lines carries their values; the text is rendered behind it."""
    from ordersight.plans import standins as S
    plan = S.encoded_orders(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "|name:" not in plan[plan.index("partial_collect_list"):]


def _rows(spark, n=240):
    return spark.range(n).select(
        F.col("id"), (F.col("id") % 40).alias("person_id"), (F.col("id") * 7 % 31).cast("double").alias("a"),
        F.when(F.col("id") % 5 > 0, (F.col("id") * 13 % 17).cast("double")).alias("b"),
        ((F.col("id") * 11 % 23 + F.col("id") % 3) > 12).cast("int").alias("y"), F.lit("wide").alias("c"))


def test_vectors_hold_what_trainers_read(spark):
    from ordersight.plans import train as TR
    v = TR.vector_table(_rows(spark), ["a", "b"], "person_id", ["y"])
    assert v.columns == ["split", "fold", "features", "y"] and v.count() == 240


def test_depths_share_a_fit(spark, monkeypatch):
    """One fit a fold and one of the best point; the figures are those of a fit for every depth."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from ordersight.operators import models as MD
    from ordersight.plans import train as TR
    train = TR.vector_table(_rows(spark), ["a", "b"], "person_id", ["y"]).withColumn("weight", F.lit(1.0))
    grid, fits, fit = {"maxDepth": [1, 2, 5], "numTrees": [3]}, [], RandomForestClassifier.fit
    want = {}
    for d in grid["maxDepth"]:
        aucs = []
        for k in range(3):
            m = MD.forest("y", "weight", numTrees=3, maxDepth=d).fit(train.where(F.col("fold") != k))
            aucs.append(BinaryClassificationEvaluator(labelCol="y", numBins=0).evaluate(m.transform(train.where(F.col("fold") == k))))
        want[f"maxDepth={d}, numTrees=3"] = round(sum(aucs) / 3, 9)
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *a, **k: fits.append(1) or fit(*a, **k))
    model, table = MD.cross_validate(train, MD.forest("y", "weight"), grid, "y", parallelism=2)
    got = {r["params"]: round(r["mean_auc"], 9) for r in table.orderBy("combination").collect()}
    assert list(got) == list(want) and got == want
    assert len(fits) == 4
    assert f"maxDepth={model.getMaxDepth()}, numTrees=3" == max(got, key=got.get)


def test_vectors_do_not_come_back_from_scoring(spark):
    """The map over the rows gives back scores, not the vectors it has read."""
    from ordersight.operators import models as MD
    from ordersight.plans import train as TR
    v = TR.vector_table(_rows(spark), ["a", "b"], "person_id", ["y"])
    m = MD.forest("y", None, numTrees=2, maxDepth=2).fit(v)
    out = MD.score_targets(v.select("y", "features"), {"t": m}, ["t", "none"], long=False)
    plan = out._jdf.queryExecution().analyzed().toString()
    back = plan[plan.index("MapInArrow"):].splitlines()[0]
    assert "_x#" not in back.split("[", 1)[1]
    assert all(r.scores[1].score == 0.0 and 0 <= r.scores[0].score <= 1 for r in out.collect())


def test_uploads_of_a_trigger_run_side_by_side(spark, tmp_path):
    import threading

    from ordersight.sources import io as IO
    from ordersight.streaming import uploads as U
    for k in range(3):
        row = {f.name: str(k) if f.name in ("order_id", "customer_id") else "" for f in IO.ORDERS_SCHEMA.fields}
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"u{k}.csv").write_text(",".join(row) + "\n" + ",".join(row.values()) + "\n")
    met = threading.Barrier(3, timeout=60)

    def work(upload):
        met.wait()  # passes only if three uploads are in work at once
        return upload.select("order_id")

    U.process_uploads(spark, str(tmp_path / "in"), str(tmp_path / "out"), work, checkpoint=str(tmp_path / "ck")).awaitTermination()
    assert sorted(int(r.order_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_network_rows_are_bytes(spark, monkeypatch):
    """A step reads each row of the network as one binary, and gives the sums of the lists it was made of."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    from ordersight.operators import perceptron as P
    stored, keep = {}, P.materialize
    monkeypatch.setattr(P, "BLOCK", 7)
    monkeypatch.setattr(P, "materialize", lambda d, name: stored.setdefault(name, keep(d, name)))
    df = _rows(spark).withColumn("features", array_to_vector(F.array("a", F.coalesce("b", F.lit(-1.0)))))
    net = P.fit_perceptron(df, [F.col("y")], [F.col("a") + 1], (4,), max_iter=3)[0]
    assert stored["perceptron_rows"].dtypes == [("row", "binary"), ("weight", "double")]
    rows = df.select("a", F.coalesce("b", F.lit(-1.0)), "y").toPandas().to_numpy(dtype=float)
    loss, _ = P.loss_and_gradient(net.flat, net.sizes, P._standard(rows[:, :2], net.mean, net.std), rows[:, 2:], rows[:, :1] + 1)
    assert abs(loss / (rows[:, 0] + 1).sum() - net.losses[-1]) < 1e-12


def test_rounds_share_a_fit(spark, monkeypatch):
    """One fit a fold and one of the best point; the figures are those of a fit for every number of rounds."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from ordersight.operators import models as MD
    from ordersight.plans import train as TR
    train = TR.vector_table(_rows(spark), ["a", "b"], "person_id", ["y"]).withColumn("weight", F.lit(1.0))
    grid, fits, fit, want = {"maxIter": [1, 3], "maxDepth": [2]}, [], GBTClassifier.fit, {}
    for n in grid["maxIter"]:
        aucs = []
        for k in range(3):
            m = MD.boosted("y", "weight", maxIter=n, maxDepth=2).fit(train.where(F.col("fold") != k))
            aucs.append(BinaryClassificationEvaluator(labelCol="y", numBins=0).evaluate(m.transform(train.where(F.col("fold") == k))))
        want[f"maxDepth=2, maxIter={n}"] = sum(aucs) / 3
    monkeypatch.setattr(GBTClassifier, "fit", lambda *a, **k: fits.append(1) or fit(*a, **k))
    model, table = MD.cross_validate(train, MD.boosted("y", "weight"), grid, "y", parallelism=2)
    got = {r["params"]: r["mean_auc"] for r in table.orderBy("combination").collect()}
    assert list(got) == list(want) and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    assert len(fits) == 4
    assert f"maxDepth=2, maxIter={model.getNumTrees}" == max(got, key=got.get)


def test_levels_are_found_without_repeating_rows(spark, monkeypatch):
    """Levels of all columns come from distinct values of each; no row is exploded into one for every column."""
    import pytest

    from ordersight.operators import encode as EC
    df = spark.range(50).select((F.col("id") % 3).cast("string").alias("a"), (F.col("id") % 2).alias("b"), F.lit(None).cast("string").alias("c"))
    skus = spark.createDataFrame([("x",), (None,), ("y",), ("x",)], "sku string")
    plans, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda d: plans.append(_plan(d)) or collect(d))
    assert EC.bounded_levels(df, ["a", "b", "c"], 3, (skus, "sku", "p")) == {"a": ["0", "1", "2"], "b": ["0", "1"], "c": [], "p": ["x", "y"]}
    assert len(plans) == 1 and "explode" not in plans[0]
    with pytest.raises(ValueError, match="'a' has more than 2 levels"):
        EC.bounded_levels(df, ["a", "b"], 2)


def test_columns_that_are_dropped_are_not_stored(spark, monkeypatch):
    """The stored orders hold the lines and what the result or a later step reads."""
    from ordersight.plans import clean as CL
    from ordersight.plans import standins as S
    stored, keep = {}, CL.materialize_table
    monkeypatch.setattr(CL, "materialize_table", lambda d, name: stored.setdefault(name, keep(d, name)))
    CL.clean_orders(S.raw_orders(spark, SF), S.census(spark, SF), S.names(spark, SF), bundles=S.TEST_BUNDLES, whitelist=S.TEST_WHITELIST)
    assert set(stored["cleaned_orders"].columns) & set(CL.DROP_AFTER_CLEAN) == {"line_items"}


def test_importances_of_one_model_join_by_feature(spark):
    """The shares of a model's features need no join without a key, also where the model's name is a constant."""
    from ordersight.operators import nodes as N
    from ordersight.plans import train as TR
    from ordersight.operators import models as MD
    v = TR.vector_table(_rows(spark), ["a", "b"], "person_id", ["y"])
    m = MD.forest("y", None, numTrees=3, maxDepth=3).fit(v)
    imp = N.CollapsedForest(m, 2, spark).importances(["a", "b"], "r")
    plan = imp._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    got = {r.feature: r.importance for r in imp.collect()}
    assert all(abs(got[f] - v) < 1e-9 for f, v in zip(["a", "b"], m.featureImportances.toArray()))


def test_field_and_strip_need_no_regex(spark):
    """An item's field and a trimmed text come from plain text functions, with what the rules say."""
    from ordersight.functions import items as FI
    from ordersight.functions import text as X
    rows = [None, "", "sku:A", "id:1|sku:OLD|x|sku:B|quantity:2", "xsku:C|sku", "sku:|sku:D:E|junk", "sku:A|sku:", "sku:é😀|",
            "|sku:F", "sku: G |q"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")

    def last(t):
        hits = [f[4:] for f in (t or "").split("|") if f.startswith("sku:")]
        return hits[-1] if hits else None

    got = df.select("i", FI.field("t", "sku").alias("v"), FI.field("t", "none").alias("n")).orderBy("i")
    assert [(r.v, r.n) for r in got.collect()] == [(last(t), None) for t in rows]
    texts = [None, "", "  ", "\t a b \r\n", "\x0b\fé 😀\x0b ", "x"]
    df2 = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df2.select("i", X.strip("t").alias("v")).orderBy("i")
    assert [r.v for r in out.collect()] == [t if t is None else t.strip(" \t\n\x0b\f\r") for t in texts]
    assert "regexp" not in _plan(out).lower() and "lambda" not in _plan(got).lower()


def test_cleaning_projection_is_not_one_long_method(spark):
    """The cleaning projection stays out of whole-stage code, whose one method would be too long to be compiled; the
    rules of the census run before the join, and a missing coupon list is no coupon."""
    from ordersight.plans import standins as S
    from ordersight.plans.clean import clean_columns
    raw = S.raw_orders(spark, SF)
    out = clean_columns(raw, S.census(spark, SF), S.names(spark, SF))
    plan = _plan(out.select("used_coupon", "mean_household_income"))
    assert "exists(" in plan[:plan.index("Join")]
    assert "[,+" in plan and "[,+" not in plan[:plan.index("Join")]  # the pattern of incomes, on the census rows
    got = {(r.coupon_items is None, r.coupon_items, r.used_coupon) for r in out.select("coupon_items", "used_coupon").collect()}
    assert (True, None, 0) in got and all(u == int(bool(t) and t.startswith("id:") and not t.startswith("id:|")) for _, t, u in got)
    unmatched = out.where("zip is null").select("is_income_censored", "median_household_income").distinct().collect()
    assert [tuple(r) for r in unmatched] == [(False, None)]


def test_large_forests_are_fitted_one_at_a_time(spark, monkeypatch):
    """Fits that run side by side are bounded by their rows, and a large forest keeps no node of every row and tree;
    neither changes a model."""
    import threading

    from pyspark.ml.classification import RandomForestClassifier

    from ordersight.operators import models as MD
    from ordersight.plans import train as TR
    rows = _rows(spark).withColumns({f"next_{t}": ((F.col("id") * k) % 7 > 2).cast("int") for k, t in ((3, "s"), (5, "t"), (8, "u"))})
    run = lambda: TR.train_target_models(rows, ["a", "b"], ["s", "t", "u"], grid={"maxDepth": [1, 3]}, numTrees=3)
    found = lambda r: sorted((x.metric, x.label, x.value) for x in r.metrics.collect() if x.metric != "best_params")
    want = found(run())
    now, most, cached, lock, fit = [0], [0], set(), threading.Lock(), RandomForestClassifier.fit

    def counted(self, *a, **k):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            cached.add(self.getCacheNodeIds())
        try:
            return fit(self, *a, **k)
        finally:
            with lock:
                now[0] -= 1

    monkeypatch.setattr(RandomForestClassifier, "fit", counted)
    monkeypatch.setattr(MD, "ROWS_AT_ONCE", 200)
    monkeypatch.setattr(MD, "NODE_IDS", 100)
    assert found(run()) == want
    assert most[0] == 1 and cached == {False}
    assert MD.fits_at_once(9_000_000, 8) == 1
