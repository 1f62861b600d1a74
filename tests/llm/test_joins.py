"""Near duplicates and nearest neighbours against brute force."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import DATA
from verdictlake.llm import ann, components, ngram_join, toxicity


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent, seen = list(range(len(rows))), collections.defaultdict(list)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = collections.Counter(j for g in s for j in seen[g])
        for g in s:
            seen[g].append(i)
        for j, k in shared.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


def hard_rows():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    base, passage, rows = list(rng.choice(words, 200)), list(rng.choice(words, 60)), []
    for _ in range(90):  # a large group of near copies
        w = list(base)
        for _ in range(int(rng.integers(0, 9))):
            w[int(rng.integers(0, 200))] = f"e{rng.integers(1e9)}"
        rows.append(w)
    for _ in range(100):  # a passage that many documents share
        w = list(rng.choice(words, int(rng.integers(3, 120))))
        k = int(rng.integers(0, len(w)))
        rows.append(w[:k] + passage + w[k:])
    for _ in range(50):  # documents that are mostly passage
        rows.append(passage[: int(rng.integers(50, 60))] + list(rng.choice(words, int(rng.integers(0, 6)))))
    for _ in range(40):
        rows.append(["a"] * int(rng.integers(0, 12)))
    return [(i, "\n".join(w)) for i, w in enumerate(rows)] + [(900, None), (901, " \t"), (902, "A b"), (903, "a\tB")]


@pytest.mark.parametrize("name", ["given", "hard"])
def test_components_against_brute_force(spark, name):
    if name == "given":
        df = spark.read.parquet(f"{DATA}/documents.parquet")
        rows = [(r.doc_id, r.text) for r in df.collect()]
    else:
        rows = hard_rows()
        df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op2(df).collect()}
    assert got == brute_components(rows)


def test_component_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "A B"), (None, None), (4, "a b"), (4, "a b")], "doc_id LONG, text STRING")
    got = sorted((tuple(r) for r in ngram_join.op2(df).collect()), key=str)
    assert got == [(4, 1, 4), (4, 1, 4), (None, 0, None), (None, 1, 4), (None, 1, 4)]
    assert ngram_join.op2(df.limit(0)).collect() == []
    assert sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(df).collect()), key=str) == [(4, "a b"), (None, None)]


def test_keep_one_tells_texts_of_one_id_apart(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "x"), (2, text, "y"), (2, "quite another text under the same id", "z"), (None, text, "n"), (3, None, "e"), (3, None, "e")]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, key STRING")
    assert sorted(r.key for r in ngram_join.keep_one(df).collect()) == ["e", "e", "x", "z"]


def test_prefix_bound_never_loses_a_link():
    rng = np.random.default_rng(3)
    lost = kept = 0
    for _ in range(4000):
        base = np.unique(rng.integers(0, 1 << 63, int(rng.integers(2, 150)), dtype=np.uint64) << np.uint64(1))
        share = rng.random()
        a, b = (np.sort(np.concatenate((base[rng.random(len(base)) < 1 - share / 3], rng.integers(0, 1 << 63, int(rng.integers(0, 9)), dtype=np.uint64)))) for _ in "ab")
        if not len(a) or not len(b) or min(len(a), len(b)) * 100 < max(len(a), len(b)) * 80:
            continue
        up = [ngram_join._upper(x).view(np.uint32) for x in (a, b)]
        cut = [ngram_join.prefix_length(len(x)) for x in (a, b)]
        may = ngram_join.may_link(len(a), len(b), tuple(x[:c] for x, c in zip(up, cut, strict=True)), tuple(x[len(x) - c :] for x, c in zip(up, cut, strict=True)))
        k = len(np.intersect1d(a, b))
        link = 100 * k >= 80 * (len(a) + len(b) - k)
        lost, kept = lost + (link and not may), kept + (may and not link)
    assert lost == 0 and kept < 1500


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (41, 50), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {40: 40, 41: 40, 50: 40}


def brute_nearest(rows):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, m = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            score = (m * v).sum(axis=1)
            out[i] = [(int(ids[j]), float(score[j])) for j in np.lexsort((ids, -score)) if ids[j] != i][:20]
    return out


def neighbours(df):
    got = collections.defaultdict(list)
    for r in ann.op6(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    return dict(got)


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got, want = neighbours(df), brute_nearest([(r.vec_id, r.embedding) for r in df.collect()])
    assert got.keys() == want.keys() and all(len(got[k]) == len(want[k]) for k in want)
    assert np.mean([len({v for v, _ in got[k]} & {v for v, _ in want[k]}) / 20 for k in want]) >= 0.9
    assert all(dict(want[k]).get(v, s) == s for k in want for v, s in got[k])


def test_small_and_tied_vectors(spark):
    odd = [(i, [float(i), 1.0, -1.0]) for i in range(9)] + [(20, None), (40, [0.0, 0.0, 0.0]), (60, [float("nan"), 1.0, 1.0]), (80, [None, 1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    tied = [(i, [1.0, 0.5, 0.25, 0.1]) for i in range(120)]
    for rows in (odd, tied):
        df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>")
        assert neighbours(df) == brute_nearest([(r.vec_id, r.embedding) for r in df.collect() if r.vec_id is not None])
    assert ann.op6(df.limit(0)).collect() == []
    mixed = spark.createDataFrame([(i, [1.0 + i % 7, float(i)][: 1 + i % 2]) for i in range(41)], "vec_id LONG, embedding ARRAY<FLOAT>")
    got = neighbours(mixed)
    rows = [(r.vec_id, r.embedding) for r in mixed.collect()]  # shorter vectors count as filled up with zeros
    for query, mine in rows:
        if query % 20 == 0:
            near = sorted(((v, sum(a * b for a, b in zip(mine, x, strict=False))) for v, x in rows if v != query), key=lambda p: (-p[1], p[0]))
            assert got[query] == near[:20]
    assert sorted(got) == [0, 20, 40]


def test_share_looked_at_and_recall_are_as_the_readme_says():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    score = x[:60] @ x.T
    score[np.arange(60), np.arange(60)] = -9
    top, seen = np.argsort(-score, axis=1)[:, :20], np.zeros((60, 1500), dtype=bool)
    for table in range(ann.TABLES):
        own, asked = ann.buckets(x, table, 1)[:, 0], ann.buckets(x[:60], table, ann.PROBES)
        for i in range(60):
            seen[i] |= np.isin(own, asked[i])
    assert np.mean([seen[i][top[i]].mean() for i in range(60)]) >= 0.95 and seen.mean() <= 0.68


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(20, 64))
    assert np.allclose(np.linalg.norm(ann.rotated(x, 3), axis=1), np.linalg.norm(x, axis=1))


def test_texts_of_rows_that_stay_are_not_dealt(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.getrandbits(64):x}" for _ in range(200))) for i in range(300)]
    rows += [(900, rows[7][1]), (901, rows[8][1] + " more"), (9, rows[9][1]), (None, None)]
    sc = spark.sparkContext._jsc.sc()

    def dealt():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id LONG, text STRING"))
        start = dealt()
        assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == list(range(300))
        assert dealt() - start < 100_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_features_come_as_a_matrix_without_python_objects():
    lists = pa.chunked_array([pa.array([[1.0, 0.5], [0.0, 2.0]], pa.list_(pa.float32())), pa.array([[3.0, 4.0]], pa.list_(pa.float32()))])
    assert toxicity.matrix(lists, 2).tolist() == [[1.0, 0.5], [0.0, 2.0], [3.0, 4.0]]
    assert toxicity.matrix(pa.chunked_array([], pa.list_(pa.float32())), 2).shape == (0, 2)
