"""Every registered query of the engine against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from rastrum.plans import raster_queries  # noqa: F401
from rastrum.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        place = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{place + '/*.parquet' if Path(place).is_dir() else place}'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(str(v) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert rows
    if name in ORACLE_SQL:
        listed = ", ".join(f'"{c}"' for c in columns)
        assert ordered(rows) == ordered(duck.sql(f"SELECT {listed} FROM ({ORACLE_SQL[name]})").fetchall())


def test_registered_names_have_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
