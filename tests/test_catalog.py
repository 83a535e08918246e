"""Every catalogue query runs on sf0.001; relational ones equal their DuckDB twin."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SLOW = {"train_return_forest", "train_return_boosted", "train_next_sku", "train_next_category",
        "train_next_neural", "score_top_products", "score_returning", "model_store",
        "train_return_forest_baseline", "train_return_boosted_baseline"}
#: The optional subpackage's queries have their own tests.
LLM = set(E._llm()[0])


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def n(v):
        if isinstance(v, float) and math.isnan(v):
            return None
        return v
    return sorted((tuple(n(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "repeat_customer" in df.columns


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - LLM - SLOW))
def test_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(res.fetchall(), dcols)


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql()) - SLOW - LLM))
def test_rows_only(spark, name):
    assert E.queries()[name](spark, SF).count() > 0


def test_every_query_has_docstring():
    for name, fn in E.queries().items():
        assert fn.__doc__, name


@pytest.mark.parametrize("name", sorted(set(E.queries()) - SLOW - {"stream_score_uploads", "feature_sink",
                                                                    "report_sink", "serve_features"} - LLM))
def test_no_cross_products(spark, name):
    """No query plans a cartesian product or a nested-loop join."""
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
