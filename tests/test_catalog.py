"""Every query that has SQL gives the same rows as DuckDB."""

import os

import duckdb
import pytest

from flowloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, sf, db, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(([rounded(r[c]) for c in cols] for r in df.collect()), key=repr)
    found = db.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(([rounded(dict(zip(names, r, strict=True))[c]) for c in cols] for r in found.fetchall()), key=repr)
    assert got == want


def test_edges_json_of_a_tiny_negative_middle(spark, tmp_path):
    """The middle of two latitudes falls short of zero by a rounding error: both sides write 0.0, not -0.0."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute("CREATE TABLE orders AS SELECT 1::BIGINT AS o_orderkey, 1502::BIGINT AS o_custkey, TIMESTAMP '1996-01-01' AS o_orderdate")
    con.execute("CREATE TABLE lineitem AS SELECT 1::BIGINT AS l_orderkey, 1 AS l_linenumber, 181::BIGINT AS l_suppkey")
    for t in ("orders", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = sorted(r["json"] for r in catalog.QUERIES["edges_json"](spark, str(tmp_path)).collect())
    assert got == sorted(r[0] for r in con.execute(catalog.SQL["edges_json"]).fetchall())
    assert len(got) == 2 and all(",0.0]" in j and "-0.0" not in j for j in got)
