"""Every registered query of the library against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from wardline.plans import registry as library

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_equals_sql(spark, sf_dir, con, name):
    df = library.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rel = con.sql(library.oracle_sql()[name])
    assert columns == sorted(rel.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())


def test_entry_and_registration():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(library.queries()) <= set(e.queries())
