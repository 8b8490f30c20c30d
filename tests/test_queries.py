"""Every query of the library's own operators against its SQL in DuckDB."""

import math

import duckdb
import pytest

from granary.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    return repr(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == want


def test_entry_imports_and_registers():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(queries.QUERIES) <= set(names) and set(entry.oracle_sql()) <= set(names)
