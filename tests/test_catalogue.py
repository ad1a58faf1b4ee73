import os

import duckdb
import pytest

from stridemill.plans import catalogue, folded, ordered  # noqa: F401 - they add their queries to the catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toArrow()
    want = duck.sql(catalogue.ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert columns == sorted(got.column_names)
    rows = [sorted(zip(*(t.column(c).to_pylist() for c in columns), strict=True), key=repr) for t in (got, want)]
    assert rows[0] == rows[1]


def test_entry_imports_without_the_corpus_operators():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
