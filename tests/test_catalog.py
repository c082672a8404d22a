"""Every registered query against its SQL on the smallest tables."""

import pathlib
import sys

import duckdb
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
from primeweft.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in pathlib.Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, sql, name):
    got = catalog.queries()[name](spark, DIR)
    want = sql.execute(f"SELECT {', '.join(f'"{c}"' for c in got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    clean = lambda rows: sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    assert clean(want) == clean(tuple(r) for r in got.collect())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_only(spark, name):
    assert catalog.queries()[name](spark, DIR).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 40
    assert set(e.oracle_sql()) <= set(e.queries())
