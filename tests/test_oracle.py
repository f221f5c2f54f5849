"""Every query with SQL gives the rows that DuckDB gives."""

import importlib.util

import duckdb
import pytest

from strandmill.plans import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    return frame[cols].sort_values(cols).reset_index(drop=True).astype(object).where(lambda x: x.notna(), None)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_same_rows(spark, sf_dir, duck, name):
    ours = rows(queries.queries()[name](spark, sf_dir).toPandas())
    theirs = rows(duck.execute(oracle.oracle_sql()[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs)
    assert ours.values.tolist() == theirs.values.tolist()


def test_entry_registers_all():
    spec = importlib.util.find_spec("__spark_entry__")
    assert spec is not None
    import __spark_entry__ as entry

    assert set(queries.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
