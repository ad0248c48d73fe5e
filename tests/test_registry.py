"""Every query of the core runs at the smallest scale, and gives what its SQL gives in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from loomgraph.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(SF + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in SQL:
        cur = db.execute(SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        assert mine == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert len(set(cols)) == len(cols)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
