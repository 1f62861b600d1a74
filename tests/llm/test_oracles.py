"""The corpus operators' SQL on the smallest tables."""

import duckdb
import pytest

from tests.conftest import DATA
from tests.test_catalog import comparable
from verdictlake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = c.execute(queries.SQL[name])
    columns = [x[0] for x in found.description]
    df = queries.QUERIES[name](spark, DATA).select(*columns)
    assert comparable([tuple(r) for r in df.collect()], columns) == comparable(found.fetchall(), columns)
