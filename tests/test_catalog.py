"""Every query against its SQL on the smallest tables."""

import decimal

import duckdb
import pytest

from tests.conftest import DATA
from verdictlake import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def cell(v):
        if isinstance(v, decimal.Decimal):
            v = float(v)
        return "~" if v is None else repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name not in catalog.SQL:
        assert rows
        return
    found = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in found.description]
    assert comparable(rows, df.columns) == comparable(found.fetchall(), columns)


def test_entry_point_without_corpus_operators():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
