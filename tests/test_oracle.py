"""Every registered query with a DuckDB twin gives the same rows."""

import glob
import os

import __spark_entry__
import pytest

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
SQL = __spark_entry__.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    own = __spark_entry__.queries()[name](spark, DATA)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(own.columns) == sorted(columns)
    names = sorted(columns)
    theirs = sorted(tuple(plain(r[columns.index(n)]) for n in names) for r in found.fetchall())
    ours = sorted(tuple(plain(v) for v in r) for r in own.select(*[f"`{n}`" for n in names]).collect())
    assert ours == theirs
