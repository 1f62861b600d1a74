"""Toxicity, mixing, fingerprints, packing and the pipeline."""

import collections
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import DATA
from verdictlake.llm import mixing, ngram_join, omh, packing, secret_scan, toxicity
from verdictlake.llm.common import WORD, global_index, stable

DOCS = "doc_id LONG, text STRING, source STRING"


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = labels.where("doc_id % 4 = 0")
    chain = toxicity.train(docs, labels.where("doc_id % 4 <> 0"))
    rows = toxicity.score(docs.select("doc_id", "text"), chain).join(held.withColumnRenamed("toxic", "y").withColumnRenamed("quality", "q"), "doc_id").collect()
    hit = sum(r.toxic == 1 and r.y == 1 for r in rows)
    assert hit / sum(r.y for r in rows) >= 0.85 and hit / sum(r.toxic for r in rows) >= 0.95  # some labels are wrong
    assert np.mean([r.low_quality == 1 - r.q for r in rows]) >= 0.98


def test_toxicity_edges(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    odd = spark.createDataFrame([(1, None, 3.0), (None, "x", 4.0)], "doc_id LONG, text STRING, p_toxic DOUBLE")
    got = toxicity.score(odd, toxicity.train(docs, labels)).collect()
    assert len(got) == 2 and all(0 <= r.p_toxic <= 1 for r in got)
    assert [r.toxic for r in toxicity.op7(odd, labels.limit(0)).collect()] == [0, 0]
    assert toxicity.op7(odd.limit(0), labels).collect() == []


def test_later_models_see_earlier_probabilities():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (600, 2)).astype(float)
    y = np.stack((x[:, 0], x[:, 0]), axis=1)
    models = toxicity.fit_chain(x, y, rng.integers(0, toxicity.FOLDS, 600), [[0], [1]])
    chain = toxicity.Chain(["a", "b"], {}, models)
    assert len(models[1].weights) == 3 and models[1].weights[2] > 1
    assert ((chain(x)[:, 1] >= 0.5) == y[:, 1].astype(bool)).all()


def plain_targets(sizes):
    """Shares of all words by weight 5, 2, 1 in code-point order, none above 3 times its source's."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]


def test_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source")
    sizes = collections.Counter()
    for r in docs.selectExpr("source", f"regexp_count(text, r'{WORD}') AS n").groupBy("source").sum("n").collect():
        sizes[r.source] = r[1]
    rows = mixing.op8(docs).collect()
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    taken, want = collections.Counter(), plain_targets(sizes)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.002 * sizes[s] for s in sizes)
    again = {r.doc_id: r.taken for r in mixing.op8(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_mix_caps_and_edges(spark):
    rows = [(i, "w " * 50, "a") for i in range(4)] + [(100 + i, "w " * 40, "b") for i in range(200)] + [(1000, None, None), (1001, "x y", None), (None, "x", "c"), (None, "x", "c"), (1002, "", "d")]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.op8(df).collect()
    assert len(got) == len(rows)
    assert all(r.taken == 3 * r.size for r in got if r.doc_id in range(4))
    assert mixing.op8(df.limit(0)).collect() == []
    mixed = mixing.apply(df.selectExpr("*", "1 AS size", "2 AS key", "3 AS copies"))
    count = collections.Counter(r.doc_id for r in mixed.collect())
    assert all(count[i] == 3 for i in range(4)) and mixed.columns == ["doc_id", "text", "source", "size", "key", "copies"]


def test_pivot_keeps_words_and_expectation():
    rng = np.random.default_rng(0)
    sizes, total = rng.integers(1, 400, 60).astype(float), np.zeros(60)
    for _ in range(1500):
        shares = np.full(60, 0.3)
        left = mixing.pivot(sizes, shares, rng)
        assert abs((sizes * shares).sum() - 0.3 * sizes.sum()) < 1e-6
        assert sum(0 < s < 1 for s in shares) == (left >= 0)
        total += shares
    assert np.abs(total / 1500 - 0.3).max() < 0.06


def test_global_index(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k").repartition(7)
    assert all(r.k == r.idx for r in global_index(df, [F.col("k").asc()], "t").collect())


def plain_fingerprint(text):
    z, place = omh.occurrences(np.frombuffer(text.encode("utf-32-le"), "<u4"))
    out = []
    for a, salt in zip(*omh._constants(omh.SLOTS, omh.SEED), strict=True):
        v = [int(a) * (int(q) >> 32) % 2**32 for q in z]
        best = sorted(sorted(range(len(z)), key=lambda i: (v[i], i))[: omh.TUPLE], key=lambda i: place[i])
        o = np.array([salt])
        for i in best:
            o = omh._mixed(o * omh.GOLD + z[i : i + 1])
        out.append(int(o[0] >> np.uint64(32)))
    return out


def test_fingerprints_against_plain_ones():
    for text in ["a", "ab", "abcdef", "abcdefg", "a" * 22, "hello world " * 30, "né😀" * 50]:
        assert list(omh.fingerprint(text)) == plain_fingerprint(text)
    assert omh.likeness(omh.fingerprint("abcdefgh ijklmnop " * 9), omh.fingerprint("ijklmnop abcdefgh " * 9)) < 1  # order counts
    z, place = omh.occurrences(np.frombuffer(("abcdef" * 3).encode("utf-32-le"), "<u4"))
    assert len(set(z.tolist())) == len(z)  # repeated k-mers are numbered apart


def test_occurrences_alike_in_texts_of_any_length():
    codes = np.random.default_rng(2).integers(97, 101, 1 << 24, dtype=np.uint32)  # one k-mer more than fit a word's lower half
    long = np.concatenate((codes, codes[:5], [96]))
    z, place = omh.occurrences(long)
    y, at = omh.occurrences(long[:50_000])
    back, front = np.empty(len(z), np.uint64), np.empty(len(y), np.uint64)
    back[place], front[at] = z, y
    assert len(long) - 5 >= 1 << 24 and (back[: len(front)] == front).all()


def test_next_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in omh.op9(docs.withColumn("part", docs.doc_id)).collect()}
    order = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    assert len(got) == len(order)
    for i, (k, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        new = omh.edited(t, after)
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == omh.written(omh.fingerprint(t)) and r.edited_fingerprint == omh.written(omh.fingerprint(new))
        assert r.near_next == omh.likeness(omh.fingerprint(t), omh.fingerprint(after))
    assert np.mean([r.near_edited for r in got.values()]) > 0.2 > np.mean([r.near_next for r in got.values()])


def test_fingerprint_edges(spark):
    rows = [(r.doc_id, r.n_chars, r.near_next) for r in omh.op9(spark.createDataFrame([(None, None, ""), (None, "", ""), (3, "x" * 50, ""), (3, "x" * 50, "")], DOCS)).collect()]
    assert sorted(rows, key=str) == [(3, 50, 0.0), (3, 50, 1.0), (None, 0, 0.0), (None, 0, 1.0)]
    assert omh.op9(spark.createDataFrame([], DOCS)).collect() == []
    assert omh.op9(spark.createDataFrame([(1, "abc", "")], DOCS).select("doc_id", "text")).first().near_next == 1.0


def test_token_ids_are_the_tokenizers(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", packing.KEPT)
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, ours = Tokenizer.from_file(path), packing.WordIds(path)
    rng = np.random.default_rng(4)
    texts = ["a b  c", "é ́x ́", "<|endoftext|> x<|startoftext|>y ab<|endoftext|> c|> d<|", "ΣΑΣ İ I", "it's 'tis we're'll x's's don't. 's, y'", "a\x1cb\x85c\xa0d", "漢字, 漢字. 😀!", "", "---", "a-b-c... x_ _y"]
    texts += ["".join(rng.choice(list("aéßΣ'.,<|>1 9½ʰ́각ㄱᄀﬁİ_\n中😀"), int(rng.integers(1, 14)))) for _ in range(800)]
    for kept in (packing.KEPT, 40):  # the first time none are kept, then those of before, then few
        for _ in range(2):
            packing.KEPT = kept
            for text, ids in zip(texts, packing.coded(pa.array(texts), ours), strict=True):
                assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(ours.kept[0]) <= 40 + len(texts)
    assert [x.tolist() for x in packing.coded(pa.array([None, "a"]), ours)] == [[], plain.encode("a", add_special_tokens=False).ids]


def test_plans_place_every_piece():
    rng = np.random.default_rng(3)
    for _ in range(120):
        cap = int(rng.integers(8, 300))
        counts = {int(rng.integers(1, cap + 1)): int(rng.integers(1, 200)) for _ in range(int(rng.integers(0, 40)))}
        bins, seen = collections.defaultdict(list), collections.Counter()
        for length, a, b, first, each, offset in packing.plan(counts, cap, 8, 6):
            for r in range(a, b):
                bins[first + (r - a) // each].append((offset + (r - a) % each * length, length))
                seen[length] += 1
        assert dict(seen) == counts and sorted(bins) == list(range(len(bins)))
        for pieces in bins.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= cap


def test_configurations_are_optimised():
    rng = np.random.default_rng(11)
    for _ in range(40):
        cap = int(rng.integers(20, 400))
        sizes = sorted({int(x) for x in rng.integers(cap // 8 + 1, cap, int(rng.integers(1, 14)))}, reverse=True)
        numbers = [int(x) for x in rng.integers(1, 300, len(sizes))]
        chosen, bound = packing.optimised(sizes, numbers, cap)
        assert all(sum(sizes[g] * n for g, n in took.items()) <= cap for took, _ in chosen)
        held = np.zeros(len(sizes))
        for took, times in chosen:
            held[list(took)] += np.array(list(took.values())) * times
        assert np.allclose(held, numbers) and sum(t for _, t in chosen) <= bound * 1.0001 + 1e-6
        whole = packing.configurations(sizes, numbers, cap)
        used = collections.Counter()
        for took, times in whole:
            used.update({g: n * times for g, n in took.items()})
        assert used == dict(enumerate(numbers)) and bound - 1e-6 <= sum(t for _, t in whole) <= bound + len(sizes) + 1


def test_packing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(50001, None), (50002, ""), (50003, "word " * 5000), (None, "x"), (50004, "same"), (50004, "same")], "doc_id LONG, text STRING")
    docs = docs.unionByName(odd).withColumn("length", docs.doc_id)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in docs.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.update((r.doc_id, i, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for i, at in enumerate(range(0, len(ids), 2048)))
    rows = packing.op10(docs).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.02 * sum(r.length for r in rows) / 2048 + 1
    assert packing.op10(docs.limit(0)).collect() == []


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    bad = {r.doc_id for r in toxicity.op7(docs, labels).where("toxic = 1").collect()}
    clean = stable(corpus_pipeline.drop_toxic(spark, docs, folder), "test-clean")  # stages are written and read again
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad
    one = stable(corpus_pipeline.keep_one_of_near_duplicates(spark, clean, folder), "test-one")
    groups = {r.doc_id: r.component_id for r in ngram_join.op2(clean).collect()}
    assert {r.doc_id for r in one.collect()} == set(groups.values())
    safe = stable(corpus_pipeline.redact_secrets(spark, one, folder), "test-safe")
    assert safe.count() == one.count() and secret_scan.op4(safe).where("spans <> ''").isEmpty() and safe.where("n_chars <> length(text)").isEmpty()
    mixed = stable(corpus_pipeline.mix_sources(spark, safe, folder), "test-mixed")
    copies = {r.doc_id: r.copies for r in mixing.op8(safe).collect() if r.copies}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == copies
    assert all(d.columns == docs.columns for d in (clean, one, safe, mixed))
    packed = corpus_pipeline.pack_sequences(spark, mixed, folder).collect()
    assert {r.doc_id for r in packed} == set(copies) and sum(r.piece == 0 for r in packed) == sum(copies.values())
    assert len(corpus_pipeline.run(spark, folder).collect()) == len(packed)


def test_equal_rows_are_mixed_apart(spark, monkeypatch):
    """Very many equal rows: no leaf of the tree holds them all, and the words still come near the target."""
    monkeypatch.setattr(mixing, "LEAF", 200)
    rows = [(1, "same words here now", "a")] * 6_000 + [(i, "w " * (i % 9 + 1), "ab"[i % 2]) for i in range(2, 3_000)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    sized = mixing.numbered(df.withColumn("k", F.xxhash64("text")), ["k"], "test-rows")
    assert sized.where("doc_id = 1").agg(F.count_distinct("copy"), F.min("copy"), F.max("copy")).first()[:] == (6_000, 0, 5_999)
    out = mixing.mix(df).persist()
    assert out.count() == len(rows)
    for r in out.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= max(0.001 * r.source_size, 9)
    assert out.agg(F.max(F.col("copies"))).first()[0] <= 3
    counts = lambda d: collections.Counter((r.doc_id, r.taken) for r in d.collect())
    assert counts(out) == counts(mixing.mix(df.repartition(3)))  # reruns agree whatever the partitions
    applied = mixing.apply(df).groupBy("doc_id", "text", "source").count().collect()
    want = collections.Counter()
    for r in out.collect():
        want[r.doc_id] += r.copies
    assert {r.doc_id: r["count"] for r in applied} == {k: n for k, n in want.items() if n}
