"""A registered query against its DuckDB SQL on the smallest tables."""

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def same_rows(spark, name, sf=SF):
    from ordersight.llm.queries import ORACLE_SQL, QUERIES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    res = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    want = sorted(res.fetchall(), key=repr)
    got = sorted((tuple(r) for r in QUERIES[name](spark, sf).select(*cols).collect()), key=repr)
    assert sorted(QUERIES[name](spark, sf).columns) == sorted(cols)
    assert got == want
    return len(got)
