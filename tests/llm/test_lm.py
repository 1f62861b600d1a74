"""The language model against a plain version with dictionaries."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from tests.conftest import DATA
from verdictlake.llm import lm

DOCS = "doc_id LONG, text STRING"


def tokens(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words] + [" "]


def counted(texts):
    n = collections.Counter()
    for text in texts:
        padded = ["^", "^", *text]
        for i in range(2, len(padded)):
            u, v, w = padded[i - 2 : i + 1]
            n.update([(w,), (v, w), (u, v, w), ("context", v), ("context", u, v)])
    return n


def plain(rows):
    """(doc_id, held_out, n_tokens, n_known, base_score, score) and P as a function of counts, for (doc_id, text) rows."""
    part = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7
    texts = [(d, part(d), tokens(t)) for d, t in rows]
    full, rest = counted([t for _, p, t in texts if p != 2]), counted([t for _, p, t in texts if p not in (2, 3)])
    size = lambda n: (sum(c for k, c in n.items() if len(k) == 1), sum(len(k) == 1 and c > 0 for k, c in n.items()))
    w3, w2, w1, last = collections.defaultdict(lambda: 0.5, {0: 0}), collections.defaultdict(lambda: 0.5, {0: 0}), 0.5, -math.inf

    def parts(n, u, v, w):
        total, types = size(n) if n is not rest else sizes
        c3, c2 = n["context", u, v], n["context", v]
        b3, b2 = c3.bit_length(), c2.bit_length()
        a3, a2 = n[u, v, w] / c3 if c3 else 0, n[v, w] / c2 if c2 else 0
        p1 = w1 * n[(w,)] / max(1, total) + (1 - w1) / (types + 1)
        p2 = w2[b2] * a2 + (1 - w2[b2]) * p1
        return b3, b2, w3[b3] * a3, w2[b2] * a2, w1 * n[(w,)] / max(1, total), p1, p2, w3[b3] * a3 + (1 - w3[b3]) * p2

    sizes = size(rest)
    events = collections.Counter((u, v, w) for _, p, t in texts if p == 3 for u, v, w in zip(["^", "^", *t], ["^", *t], t, strict=False))
    for _ in range(lm.ROUNDS):
        sums, fit = collections.defaultdict(float), 0.0
        for (u, v, w), n in events.items():
            b3, b2, r3, r2, r1, p1, p2, p = parts(rest, u, v, w)
            left = (1 - w3[b3]) / p
            for key, x in {(3, b3, "hit"): r3 / p, (3, b3, "all"): 1, (2, b2, "hit"): left * r2, (2, b2, "all"): left * p2, (1, "hit"): left * (1 - w2[b2]) * r1, (1, "all"): left * (1 - w2[b2]) * p1}.items():
                sums[key] += n * x
            fit += n * math.log10(p)
        if not events:
            break
        for key in list(sums):
            if key[-1] == "all" and key[1] != 0 and sums[key]:
                value = sums[(*key[:-1], "hit")] / sums[key]
                if key[0] == 1:
                    w1 = min(1 - 1e-9, value)
                else:
                    (w3 if key[0] == 3 else w2)[key[1]] = value
        fit /= sum(events.values())
        if fit - last < lm.GAIN:
            break
        last = fit
    sizes_full = size(full)
    out = []
    for d, p, t in texts:
        base = sum(math.log10((full[(w,)] + 1) / (sizes_full[0] + sizes_full[1] + 1)) for w in t)
        sizes = sizes_full
        n = full
        score = 0.0
        for u, v, w in zip(["^", "^", *t], ["^", *t], t, strict=False):
            c3, c2 = n["context", u, v], n["context", v]
            p1 = w1 * n[(w,)] / max(1, sizes[0]) + (1 - w1) / (sizes[1] + 1)
            p2 = (w2[c2.bit_length()] * n[v, w] / c2 if c2 else 0) + (1 - w2[c2.bit_length()]) * p1
            score += math.log10((w3[c3.bit_length()] * n[u, v, w] / c3 if c3 else 0) + (1 - w3[c3.bit_length()]) * p2)
        out.append((d, p == 2, len(t), sum(full[(w,)] > 0 for w in t), sizes_full[0], base, score))
    return out, (w3, w2, w1)


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[2:4], round(r[5], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-6)


def test_op12_equals_plain(spark, monkeypatch):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want, _ = plain(rows)
    monkeypatch.setattr(lm, "TOGETHER", 1 << 14)
    same([tuple(r) for r in lm.op12(df.repartition(5)).collect()], want)


def test_op12_on_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate([None, "", " ", "a b a b", "A B a b", "ÄA b c", "x " * 2000, "\x1c a\x0bb", "end", "a b c d e f", "a b"] * 3)] + [(None, "a b"), (None, None), (3, "a b"), (3, "a b")]
    df = spark.createDataFrame([(*r, True, 0) for r in rows], f"{DOCS}, deleted BOOLEAN, tokens INT")
    same([tuple(r) for r in lm.op12(df).collect()], plain(rows)[0])
    assert lm.op12(df.limit(0)).collect() == []
    alone = [(d, "a b") for d in range(40) if zlib.crc32(str(d).encode()) % 7 == 2]
    same([tuple(r) for r in lm.op12(spark.createDataFrame(alone, DOCS)).collect()], plain(alone)[0])


def test_probabilities_add_up_and_beat_the_base(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored, model = lm.score(df)
    held = scored.where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert held[0] > held[1]
    assert 0 < model.w1 < 1 and all(0 <= w <= 1 for w in model.w3 + model.w2) and model.w3[0] == model.w2[0] == 0
    rng = np.random.default_rng(0)
    words = rng.multinomial(model.tokens, np.ones(model.types) / model.types)  # any counts that add up to the training's
    bigram, trigram = rng.multinomial(37, np.ones(model.types) / model.types), rng.multinomial(5, np.ones(model.types) / model.types)
    k = [np.append(x, 0) for x in (words, bigram, trigram)]  # and the unknown word
    assert model.probability(k, [np.full(len(k[0]), 37), np.full(len(k[0]), 5)]).sum() == pytest.approx(1)


def test_packed_numbers_come_back():
    for kind in (np.uint64, np.uint32):
        values = np.array([0, 1, 255, 1 << 31, 7], dtype=kind)
        assert (lm.unpacked(lm.packed(values), kind) == values).all() and len(lm.unpacked(lm.packed(values[:0]), kind)) == 0
