"""Corpus queries with SQL against that SQL, in DuckDB, over the smallest tables."""

import os

import pytest

from strandloom.llm import queries

duckdb = pytest.importorskip("duckdb")
TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the provided tables are not here")


def plain(rows):
    return sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    got = queries.QUERIES[name](spark, TABLES)
    with duckdb.connect() as db:
        for table in ("documents", "pages", "conversations"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{TABLES}/{table}.parquet')")
        wanted = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert plain(got.collect()) == plain(wanted)
