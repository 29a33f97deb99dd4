"""Every query of the catalogue that has SQL gives the rows that the SQL gives."""

import glob
import os

import duckdb
import pytest

from foliospark.plans import catalogue

from .conftest import DATA


def cell(v):
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    at = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    mine = sorted([cell(r[i]) for i in at] for r in df.collect())
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == sorted(df.columns)
    assert mine == sorted([cell(r[i]) for i in at] for r in cur.fetchall())


def test_rows_of_the_others(spark):
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        catalogue.queries()[name](spark, DATA).count()
