"""Every registered map query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from starquilt.plans import QUERIES, SQL

FOLDER = os.environ.get("STARQUILT_TABLES", "/root/testdata/sf0.001")
TABLES = ("region", "orders", "lineitem", "events")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    order = sorted(got.columns)
    rows = sorted(map(repr, (tuple(r) for r in got.select(*order).collect())))
    assert name in SQL
    want = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in order)} FROM ({SQL[name]})")
    assert rows == sorted(map(repr, want.fetchall()))


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
    assert e.entry(spark).columns == ["pix", "v", "n", "fraction"]


def test_without_text_operators():
    """The map side does not import the text operators, and the driver's entry stands without them."""
    import subprocess
    import sys

    code = "import sys; sys.modules['starquilt.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'sum_union' in q and not [k for k in q if k.startswith('op') and k[2].isdigit()], list(q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
