"""Every registered query with SQL equals it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from braidwork.plans import catalog
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, tmp_path, name):
    catalog.QUERIES[name](spark, DATA).write.parquet(f"{tmp_path}/out")
    duck.execute(f"CREATE OR REPLACE TABLE a AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    duck.execute(f"CREATE OR REPLACE TABLE b AS {catalog.SQL[name]}")
    columns = [r[0] for r in duck.execute("DESCRIBE b").fetchall()]
    assert sorted(columns) == sorted(r[0] for r in duck.execute("DESCRIBE a").fetchall())
    cols = ", ".join(f'"{c}"' for c in columns)
    for x, y in (("a", "b"), ("b", "a")):
        assert duck.execute(f"SELECT {cols} FROM {x} EXCEPT ALL SELECT {cols} FROM {y} LIMIT 3").fetchall() == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
