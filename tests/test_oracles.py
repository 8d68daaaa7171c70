"""Every query with SQL gives the same rows as DuckDB over the smallest driver tables."""

import math
import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def canonical(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "-"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{v:.7g}"
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    found = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert canonical(map(tuple, df.select(*[f"`{c}`" for c in columns]).collect())) == canonical(found)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
