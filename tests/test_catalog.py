import duckdb
import pytest

from netquilt.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "nation", "customer", "part"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def _plain(v):
    return round(float(v), 6) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    want = duck.sql(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({catalog.ORACLES[name]})").fetchall()
    rows = [tuple(map(_plain, r)) for r in got.select(*names).collect()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(map(_plain, r))) for r in want)
