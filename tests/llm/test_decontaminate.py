"""Decontamination against brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ordersight.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w = WORD.findall(lower(text))
        spots, own = set(), set()
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    spots |= set(range(i, i + n))
                    own |= windows[tuple(w[i:i + n])]
        out.append((doc, len(w), len(spots), sorted(x for x in own if x is not None)))
    return sorted(out, key=repr)


ITEM = "Alpha beta, gamma-delta Épsilon zeta eta theta iota kappa lambda mu nu"
DOCS = [(1, ITEM), (2, "x " + ITEM.upper().replace("É", "É") + " y " + ITEM), (3, None), (4, ""), (5, "!!! ..."),
        (6, "short one here short one"), (7, "alpha beta gamma delta"), (None, ITEM), (8, "tail " + ITEM[:40]),
        (9, ITEM), (9, ITEM), (10, "word " * 5000 + ITEM)]
ITEMS = [(100, ITEM), (101, ITEM), (102, "Short one"), (103, None), (104, "..."), (None, "tail alpha"), (100, ITEM),
         (2, "eta theta iota kappa lambda mu nu xi omicron pi rho")]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_scan_equals_brute_force(spark, limit):
    docs = spark.createDataFrame([(d, t, 1, "w") for d, t in DOCS], "doc_id long, text string, row int, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.scan(docs, items, max_broadcast=limit).select("doc_id", "n_words", D.covered(F.col("hits")), "items")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.scan(docs.limit(0), items).count() == 0
    got = D.scan(docs, items.limit(0)).collect()
    assert len(got) == len(DOCS) and all(r.hits == [] and r["items"] == [] for r in got)


def test_clean_drops_only_hit_documents(spark):
    docs = spark.createDataFrame([(d, t, "s") for d, t in DOCS], "doc_id long, text string, n_words string")
    left = D.clean(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == [3, 4, 5, 7]


def test_query_equals_brute_force(spark):
    from ordersight.llm.queries import op3_decontaminate
    sf = "/root/testdata/sf0.001"
    rows = {t: [(r[0], r.text) for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]
            for t in ("documents", "benchmark")}
    want = [(d, n, k, len(i), hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest(), k > 0)
            for d, n, k, i in brute(rows["documents"], rows["benchmark"])]
    got = op3_decontaminate(spark, sf).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert any(r[-1] for r in want)
    plan = op3_decontaminate(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_sql(spark):
    from tests.llm.oracle import same_rows
    assert same_rows(spark, "op3_decontaminate")


def test_windows_pass_as_hashes(spark):
    """A window is exploded as its hash alone; its words are cut from the run where the hash is found."""
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(30))), (2, "short one"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(3, 15))), (8, "Short one"), (9, "none of it")], "item_id long, text string")
    out = D.scan(docs, items)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert any("posexplode(all" in line and "key#" in line and "gram#" not in line for line in plan.splitlines())
    rows = lambda df: sorted((r.doc_id, r.n_words, [tuple(h) for h in r.hits], list(r["items"])) for r in df.collect())
    want = [(1, 31, [(4, 14), (5, 15), (6, 16)], [7]), (2, 2, [(0, 2)], [8]), (3, 0, [], [])]
    assert rows(out) == rows(D.scan(docs, items, max_broadcast=0)) == want
