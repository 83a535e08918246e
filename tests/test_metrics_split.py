"""Metrics V1-V13 on the FIXTURES.md scored rows and a brute force; split and weights."""

import random

import pytest
from pyspark.sql import functions as F

from ordersight.operators import metrics as M
from ordersight.operators import split as SP


def _scored(spark, rows):
    return spark.createDataFrame(rows, "target string, y int, score double")


FIX = [("t", 1, 0.9), ("t", 0, 0.9), ("t", 1, 0.4), ("t", 0, 0.1)]


def test_auc_ties_half(spark):
    assert M.auc(_scored(spark, FIX)).first()["auc"] == pytest.approx(0.625)


def _brute_auc(rows):
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_and_curve_brute_force(spark):
    rnd = random.Random(5)
    rows = [("a" if i % 3 else "b", int(rnd.random() < 0.3), round(rnd.random(), 2)) for i in range(800)]
    df = _scored(spark, rows)
    assert M.auc(df).first()["auc"] == pytest.approx(_brute_auc(rows), rel=1e-12)
    per = {r["target"]: r["auc"] for r in M.auc(df, ["target"]).collect()}
    for t in ("a", "b"):
        assert per[t] == pytest.approx(_brute_auc([r for r in rows if r[0] == t]), rel=1e-12)
    pr = M.pr_curve(df).collect()
    P = sum(y for _, y, _ in rows)
    for r in pr:
        if r["threshold"] is None:
            assert (r["precision"], r["recall"]) == (1.0, 0.0)
            continue
        tp = sum(1 for _, y, s in rows if y == 1 and s >= r["threshold"])
        fp = sum(1 for _, y, s in rows if y == 0 and s >= r["threshold"])
        assert r["tp"] == tp and r["fp"] == fp and r["recall"] == pytest.approx(tp / P)
    assert len(pr) == len({s for _, _, s in rows}) + 1


def test_thresholds(spark):
    df = _scored(spark, FIX)
    best = M.threshold_best_f1(df).first()
    # points: t=0.1 (p=.5, r=1), t=0.4 (p=2/3, r=1), t=0.9 (p=.5, r=.5) -> best F1 at 0.4
    assert best["threshold"] == 0.4
    assert M.threshold_min_precision(df, 0.6).first()["threshold"] == 0.4
    assert M.threshold_min_precision(df, 0.99).first()["threshold"] == 1.0
    assert M.threshold_precision_recall(df, 0.3).first()["threshold"] == 0.1
    sw = M.threshold_sweep(df, M.sweep_thresholds(spark)).first()
    assert 0.01 <= sw["threshold"] <= 0.9
    th = [r["threshold"] for r in M.sweep_thresholds(spark).collect()]
    assert len(th) == 100 and th[0] == 0.01 and th[-1] == 0.9


def test_reports(spark):
    df = _scored(spark, FIX)
    conf = {(r["y"], r["pred"]): r["n"] for r in M.confusion(df, 0.5).collect()}
    assert conf == {(1, 1): 1, (0, 1): 1, (1, 0): 1, (0, 0): 1}
    pm = M.pooled_metrics(df, 0.5).first()
    assert pm["accuracy"] == 0.5 and pm["f1_macro"] == 0.5
    rep = {r["label"]: r for r in M.class_report(df, 0.5).collect()}
    assert set(rep) == {"0", "1", "macro avg", "weighted avg"} and rep["1"]["support"] == 2


def test_split_disjoint_and_stable(spark):
    rows = [(f"p{i % 300}", i, int(i % 7 == 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "person_id string, order_id long, repeat_customer int")
    a = {r["person_id"]: r["split"] for r in SP.person_split(df).collect()}
    b = {r["person_id"]: r["split"] for r in SP.person_split(df.repartition(7)).collect()}
    assert a == b
    assert SP.leak_check(SP.with_split(df)).first()["overlap"] == 0
    share = sum(1 for v in a.values() if v == "test") / len(a)
    assert 0.1 < share < 0.3
    cw = {r["label"]: r for r in SP.class_weights(df).collect()}
    n1 = sum(1 for r in rows if r[2] == 1)
    assert cw[1]["balanced_weight"] == pytest.approx(3000 / (2 * n1))
    assert cw[0]["scale_pos_weight"] == pytest.approx((3000 - n1) / n1)


def test_label_weights(spark):
    lab = spark.createDataFrame([(1, "A", 1), (2, "A", 1), (3, "B", 1), (4, "C", 0)],
                                "order_id long, sku string, y int")
    w = {r["sku"]: r["weight"] for r in SP.label_weights(lab).collect()}
    assert w == {"A": 3 / (3 * 2), "B": 3 / (3 * 1), "C": 3 / (3 * 1)}
    assert {r["order_id"] for r in SP.labelled_rows(lab).collect()} == {1, 2, 3}


def test_curves_are_monotone(spark):
    rnd = random.Random(9)
    rows = [("a", int(rnd.random() < 0.4), round(rnd.random(), 3)) for _ in range(500)]
    pr = sorted((r["threshold"], r["recall"]) for r in M.pr_curve(_scored(spark, rows)).collect()
                if r["threshold"] is not None)
    recalls = [r for _, r in pr]
    assert all(a >= b for a, b in zip(recalls, recalls[1:]))      # recall falls as t rises
    roc = sorted((r["threshold"], r["fpr"], r["tpr"]) for r in M.roc_curve(_scored(spark, rows)).collect()
                 if r["threshold"] is not None)
    assert all(a[1] >= b[1] and a[2] >= b[2] for a, b in zip(roc, roc[1:]))


def test_chunked_score_path_matches_brute_force(spark, monkeypatch):
    """Force every target through the chunked (score-bucket) path."""
    monkeypatch.setattr(M, "DEFAULT_HOT_THRESHOLD", 10)
    rnd = random.Random(11)
    rows = [("a" if i % 4 else "b", int(rnd.random() < 0.35), round(rnd.random(), 4)) for i in range(600)]
    df = _scored(spark, rows)
    per = {r["target"]: r["auc"] for r in M.auc(df, ["target"]).collect()}
    for t in ("a", "b"):
        assert per[t] == pytest.approx(_brute_auc([r for r in rows if r[0] == t]), rel=1e-12)
    for r in M.pr_curve(df).collect():
        if r["threshold"] is None:
            continue
        tp = sum(1 for _, y, s in rows if y == 1 and s >= r["threshold"])
        fp = sum(1 for _, y, s in rows if y == 0 and s >= r["threshold"])
        assert (r["tp"], r["fp"]) == (tp, fp)
    best = M.threshold_sweep(df, M.sweep_thresholds(spark)).first()
    monkeypatch.setattr(M, "DEFAULT_HOT_THRESHOLD", 10**9)
    assert M.threshold_sweep(df, M.sweep_thresholds(spark)).first() == best
