"""Every registered query against its reference SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from surveyfx.plans import oracle, oracle_newton  # noqa: F401 - the second adds its entries to the first
from surveyfx.plans.queries import REGISTRY as QUERIES

ORACLE = oracle.SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def normal_form(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(r[i] for i in order) for r in rows]
    return sorted(table, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_sql(spark, duck, sf_dir, key):
    df = QUERIES[key](spark, sf_dir)
    cursor = duck.execute(ORACLE[key])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    expected = normal_form(cursor.fetchall(), columns)
    assert normal_form([tuple(r) for r in df.collect()], df.columns) == expected
    assert expected


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["question", "party", "diff_effect", "se_diff_effect", "z_stat", "p_value", "significance"]
    assert df.count() == 16
