"""History features W1-W13: hand-computed fixture rows and a brute-force check
on a skewed table (one person with a third of all rows, many chunks)."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from ordersight.operators.history import history_features, repeat_flags

D = dt.datetime


def _orders(spark, rows):
    return spark.createDataFrame(rows, "person_id string, order_id long, order_datetime timestamp_ntz, "
                                       "order_total double")


def test_fixture_rules(spark):
    # FIXTURES.md orders 1-5 (person "ana test 97209" has 4 orders, 3 and 4 tie).
    rows = [("p", 1, D(2024, 1, 1, 2), 100.0), ("p", 2, D(2024, 1, 2, 1), 50.0),
            ("p", 3, D(2024, 4, 1, 1), 70.0), ("p", 4, D(2024, 4, 1, 1), None),
            (None, 5, D(2024, 5, 1), 10.0)]
    for hot in (None, 10**9):
        _check_fixture({r["order_id"]: r for r in
                        history_features(_orders(spark, rows), hot_threshold=hot).collect()})


def _check_fixture(out):
    o1, o2, o3, o4, o5 = (out[i] for i in range(1, 6))
    assert o1["time_since_last_purchase"] is None and o1["number_of_past_orders"] == 0
    assert o1["repeat_customer"] == 1 and o1["repeat_customer_initial"] == 0
    # 23 hours after order 1: 0 whole days.
    assert o2["time_since_last_purchase"] == 0 and o2["time_between_purchases"] == 0.0
    # Order 3: exactly 90 days after order 2 (counted), 90 days 23 h after order 1 (not).
    assert o3["order_frequency_90_days"] == 1
    assert o3["time_since_first_purchase"] == 90
    assert o3["time_since_last_purchase"] == 90
    # gaps among previous orders: [0] over n = 2 orders.
    assert o3["time_between_purchases"] == 0.0
    assert o3["average_order_value"] == 75.0 and o3["total_order_value"] == 150.0
    assert math.isclose(o3["std_order_value"], math.sqrt(1250.0))
    # Order 4: tie with order 3, broken by order id; null total ignored afterwards.
    assert o4["number_of_past_orders"] == 3 and o4["time_since_last_purchase"] == 0
    assert o4["order_frequency_90_days"] == 2
    assert o4["repeat_customer"] == 0
    # time_between: gaps among previous (0, 90) / 3
    assert o4["time_between_purchases"] == pytest.approx(30.0)
    # Null person: row kept, history null.
    assert o5["number_of_past_orders"] is None and o5["repeat_customer"] is None


def _brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    res = {}
    for p, lst in by.items():
        lst.sort(key=lambda r: (r[2], r[1]))
        for i, r in enumerate(lst):
            prev = lst[:i]
            days = [(r[2] - q[2]).total_seconds() for q in prev]
            n = len(prev)
            gaps = [math.floor((prev[k][2] - prev[k - 1][2]).total_seconds() / 86400) for k in range(1, n)]
            last = math.floor(days[-1] / 86400) if n else None
            vals = [q[3] for q in prev if q[3] is not None]
            std = None
            if len(vals) > 1:
                m = sum(vals) / len(vals)
                std = math.sqrt(sum((v - m) ** 2 for v in vals) / (len(vals) - 1))
            res[r[1]] = dict(
                time_since_last_purchase=last,
                time_between_purchases=None if n == 0 else (float(last) if n == 1 else sum(gaps) / n),
                time_since_first_purchase=math.floor(days[0] / 86400) if n else None,
                number_of_past_orders=n,
                order_frequency_90_days=sum(1 for x in days if x <= 90 * 86400),
                average_order_value=sum(vals) / len(vals) if vals else None,
                std_order_value=std,
                repeat_customer=int(i < len(lst) - 1))
    return res


@pytest.mark.parametrize("bucket,hot", [(86400, None), (3600, None), (86400, 50), (86400, 10**9)])
def test_matches_brute_force_on_skewed_data(spark, bucket, hot):
    """hot=None: all chunked; 50: person 0 chunked, others plain; 10**9: all plain."""
    rnd = random.Random(7)
    rows, oid = [], 0
    start = D(2023, 1, 1)
    for p in range(30):
        # person 0 holds about a third of all rows
        k = 300 if p == 0 else rnd.randint(1, 20)
        for _ in range(k):
            oid += 1
            t = start + dt.timedelta(seconds=rnd.randint(0, 400 * 86400))
            if rnd.random() < 0.1 and rows:
                t = rows[-1][2]  # same-second ties
            total = None if rnd.random() < 0.05 else round(rnd.uniform(5, 500), 2)
            rows.append((f"p{p}", oid, t, total))
    got = {r["order_id"]: r for r in history_features(_orders(spark, rows), bucket=bucket,
                                                       hot_threshold=hot).collect()}
    exp = _brute(rows)
    assert len(got) == len(exp)
    for oid, e in exp.items():
        g = got[oid]
        for k, v in e.items():
            if v is None:
                assert g[k] is None, (oid, k)
            elif isinstance(v, float):
                assert g[k] == pytest.approx(v, rel=1e-9, abs=1e-9), (oid, k)
            else:
                assert g[k] == v, (oid, k)


@pytest.mark.parametrize("hot", [None, 50])
def test_all_orders_of_a_hot_person_share_a_second(spark, monkeypatch, hot):
    """The instant is cut into several parts, and every feature is as the brute force has it."""
    from ordersight.operators import history as H
    from ordersight.operators import prefix as X
    seen, parts = [], H.with_parts

    def counted(df, keys, *a):
        out = parts(df, keys, *a)
        if "_part" in out.columns:
            seen.append(out.groupBy(*keys).agg(F.countDistinct("_part").alias("k")).agg(F.max("k")).first()[0])
        return out

    monkeypatch.setattr(H, "with_parts", counted)
    monkeypatch.setattr(X, "with_parts", counted)
    rnd = random.Random(9)
    rows = [("p0", i, D(2024, 3, 1, 12), None if i % 17 == 0 else round(rnd.uniform(5, 500), 2)) for i in range(400)]
    rows += [("p0", 1000 + i, D(2024, 3, 1, 12) + dt.timedelta(hours=rnd.randint(-5000, 5000)), 10.0) for i in range(60)]
    rows += [(f"p{1 + i % 7}", 2000 + i, D(2024, 3, 1) + dt.timedelta(days=rnd.randint(0, 200)), 5.0) for i in range(80)]
    rnd.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["order_id"]: r for r in history_features(_orders(spark, rows), hot_threshold=hot,
                                                          instant_threshold=40).collect()}
        flags = {r["order_id"]: r["repeat_customer"] for r in repeat_flags(
            _orders(spark, rows), hot_threshold=hot, instant_threshold=40).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    exp = _brute(rows)
    assert len(got) == len(exp) and max(seen) >= 4 and len(seen) == 2
    for oid, e in exp.items():
        assert flags[oid] == e["repeat_customer"]
        for k, v in e.items():
            assert got[oid][k] == (pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else v), (oid, k)


def test_repeat_flags(spark):
    rows = [("a", 1, D(2024, 1, 1), 1.0), ("a", 2, D(2024, 1, 1), 1.0), ("b", 3, D(2024, 1, 3), 1.0)]
    out = {r["order_id"]: r for r in repeat_flags(_orders(spark, rows)).collect()}
    assert (out[1]["repeat_customer_initial"], out[1]["repeat_customer"]) == (0, 1)
    assert (out[2]["repeat_customer_initial"], out[2]["repeat_customer"]) == (1, 0)
    assert (out[3]["repeat_customer_initial"], out[3]["repeat_customer"]) == (0, 0)


def test_bucket_must_divide_a_day(spark):
    with pytest.raises(ValueError):
        history_features(_orders(spark, [("a", 1, D(2024, 1, 1), 1.0)]), bucket=7 * 86400)


def test_one_full_shuffle(spark):
    rows = [("a", i, D(2024, 1, 1 + i), 1.0) for i in range(5)]
    plan = history_features(_orders(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_invariants_on_test_orders(spark):
    """W4 = orders - 1 at each person's last order; labels: exactly one 0 per person."""
    from ordersight.plans import standins as S
    from tests.conftest import SF
    h = history_features(S.history_orders(spark, SF))
    per = h.groupBy("person_id").agg(F.count("*").alias("n"), F.max("number_of_past_orders").alias("w4"),
                                     F.sum(1 - F.col("repeat_customer")).alias("last"))
    bad = per.filter((F.col("w4") != F.col("n") - 1) | (F.col("last") != 1)).count()
    assert bad == 0


def test_hot_key_list_is_bounded(spark):
    from ordersight.operators.prefix import hot_keys, split_hot
    df = spark.createDataFrame([(f"p{i % 5}", i) for i in range(100)] + [("big", i) for i in range(300)],
                               "person_id string, order_id long")
    assert hot_keys(df, ["person_id"], 100, 10) == [("big",)]
    assert hot_keys(df, ["person_id"], 10, 2) is None          # too many hot keys: chunk everyone
    light, hot = split_hot(df, ["person_id"], [("big",)])
    assert hot.count() == 300 and light.count() == 100
