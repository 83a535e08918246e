"""The stored contract (E1, E2, S6) and the exact stratified split (M1)."""

import hashlib
import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ordersight.operators import contract as C
from ordersight.operators import split as SP


def test_levels_keep_their_slots(spark, tmp_path):
    train = spark.createDataFrame([("b", 1.0, "x"), ("a", 2.0, None), ("c", None, "x"), ("b", 3.0, "y")] * 50, "k string, v double, w string")
    levels = C.fit_levels(train, ["k", "w"])
    rows = {(r["column"], r.level, r.slot) for r in levels.collect()}
    assert rows == {("k", "a", 0), ("k", "b", 1), ("k", "c", 2), ("w", "x", 0), ("w", "y", 1)}
    made = C.one_hot_saved(train, ["k", "w"], levels, C.level_counts(levels))
    C.write_contract(made, levels, str(tmp_path / "c"))
    saved = C.read_contract(spark, str(tmp_path / "c"))
    assert saved.sparse == ["k", "w"] and [n for n, _, _ in saved.columns] == made.columns

    later = spark.createDataFrame([("c", "y"), ("b", "x"), ("new", None), (None, "new")], "k string, w string")
    enc = C.one_hot_saved(later, saved.sparse, saved.levels, C.level_counts(saved.levels))
    got = saved.apply(enc)
    assert got.columns == made.columns
    slot = lambda c: F.array_position(vector_to_array(c), 1.0) - 1
    rows = sorted((r[0], r[1], r[2]) for r in got.select(slot("k_vec"), slot("w_vec"), "v").collect())
    assert rows == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0), (3, 2, 0.0)]


def test_changed_columns_raise(spark, tmp_path):
    train = spark.createDataFrame([("a", 1.0, True)], "k string, v double, f boolean")
    levels = C.fit_levels(train, ["k"])
    C.write_contract(C.one_hot_saved(train, ["k"], levels, {"k": 1}), levels, str(tmp_path / "c"))
    saved = C.read_contract(spark, str(tmp_path / "c"))
    with pytest.raises(ValueError, match="'v' is text, was number"):
        saved.apply(C.one_hot_saved(spark.createDataFrame([("a", "1")], "k string, v string"), ["k"], saved.levels, {"k": 1}))
    with pytest.raises(ValueError, match="'k_vec' is missing"):
        saved.apply(spark.createDataFrame([(1.0,)], "v double"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        C.read_contract(spark, str(tmp_path / "none"))


def test_no_levels_and_empty_tables(spark):
    none = spark.createDataFrame([(None,)], "k string")
    levels = C.fit_levels(none, ["k"])
    assert levels.count() == 0
    v = C.one_hot_saved(none, ["k"], levels, C.level_counts(levels)).first()[0]
    assert v.size == 1 and v.indices.tolist() == [0]
    assert C.fit_levels(none.limit(0), []).count() == 0


@pytest.mark.parametrize("sizes", [(37, 163), (1, 4), (50, 0), (3, 3, 3)])
def test_stratified_split_is_exact(spark, sizes):
    persons = [(f"p{s}-{k}", s) for s, n in enumerate(sizes) for k in range(n)] + [(None, 0)]
    got = SP.stratified_split(spark.createDataFrame(persons, "person_id string, has_positive int").repartition(5)).collect()
    named = [p for p in persons if p[0]]
    assert len(got) == len(named)
    total = len(named)
    quota = math.ceil(total / 5)
    assert sum(r.split == "test" for r in got) == quota
    for s, n in enumerate(sizes):
        own = [r for r in got if r.has_positive == s]
        taken = {r.person_id for r in own if r.split == "test"}
        assert quota * n // total <= len(taken) <= quota * n // total + 1
        digest = lambda p: hashlib.md5(f"42|{p}".encode()).hexdigest()
        order = sorted((r.person_id for r in own), key=lambda p: (int(digest(p)[:8], 16) % 10000, digest(p), p))
        assert taken == set(order[:len(taken)])
