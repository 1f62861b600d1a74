"""Searches for many queries in blocks."""

from pyspark.sql import functions as F

from tests.conftest import DATA
from verdictlake import catalog
from verdictlake.operators import retrieval


def test_blocks_give_the_nearest_of_all(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    rows += [(None, rows[0][1]), (9_000_001, rows[0][1]), (9_000_002, None)]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>")
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in retrieval.top_k(df, asked, 7, block=60, query_block=8).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, round(r.score, 6))
    last = 1 << 62
    for i, q in rows:
        if i is not None and i % 20 == 0 and q:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), last if j is None else j) for j, v in rows if v)[:7]
            assert got.pop(i) == {n + 1: (None if j == last else j, round(-s, 6)) for n, (s, j) in enumerate(scored)}
    assert not got


def test_searches_without_rows_or_queries(spark, tmp_path):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    for name, df in (("empty", vectors.limit(0)), ("no_query", vectors.where("vec_id % 100 <> 0"))):
        df.write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        for q in ("cosine_topk", "tiered_search", "cosine_topk_all", "tiered_search_all"):
            assert catalog.QUERIES[q](spark, f"{tmp_path}/{name}").collect() == []


def test_asof_join_equals_plain(spark):
    import datetime as dt
    import random

    r = random.Random(2)
    day = lambda: None if r.random() < 0.1 else dt.date(2020, 1, 1) + dt.timedelta(r.randrange(400))
    versions = [(r.choice([None, 1, 2, 3]), day(), i) for i in range(150)]
    asked = [(i, r.choice([None, 1, 2, 3, 4]), day()) for i in range(300)] + [(7, 1, dt.date(2020, 6, 1))] * 2
    v, q = spark.createDataFrame(versions, "k INT, since DATE, n INT"), spark.createDataFrame(asked, "id INT, k INT, d DATE")
    for days in (7, 1000):
        got = sorted(((x.id, x.version and x.version.n) for x in retrieval.asof_join(q, v, "k", "d", "since", ["n"], days).collect()), key=str)
        best = lambda k, d: max(((s, n) for key, s, n in versions if key == k and s and d and s <= d), default=(None, None))[1] if k else None
        assert got == sorted(((i, best(k, d)) for i, k, d in asked), key=str)
    assert retrieval.asof_join(q.limit(0), v, "k", "d", "since", ["n"]).collect() == []


def test_vectors_of_odd_shapes(spark):
    rows = [(0, [3.0]), (1, [1.0, 9.0]), (2, [2.0, -1.0, 5.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []), (7, [float("inf")])]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>")
    queries = df.select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.vec_id): r.score for r in retrieval.top_k(df, queries, 10).collect()}
    good = {i: v for i, v in rows if i in (0, 1, 2, 6)}
    assert got == {(a, b): sum(x * y for x, y in zip(u, v, strict=False)) for a, u in good.items() for b, v in good.items()}
