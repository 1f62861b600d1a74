"""Alignment of two tokenizers against a plain version over whole texts."""

import collections
import hashlib

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.conftest import DATA
from verdictlake.llm import align

DOCS = "doc_id LONG, text STRING"


def plain(rows):
    """The contract's columns for (doc_id, text) rows, each text encoded whole."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
    size = {i: (bytes(sign[c] for c in t) if i != 50256 else t.encode()) for t, i in a.get_vocab().items()}
    found, count = [], collections.Counter()
    for doc, text in rows:
        ids_a = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        of_a = [size[i] for i in ids_a]
        of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not (b"".join(of_a) == b"".join(of_b) == f" {text}".encode()):
            ids_a = ids_b = of_a = of_b = []
        groups, i, j, at, to = [], 0, 0, 0, 0
        left = [[], []]
        while i < len(ids_a) or j < len(ids_b):
            if at <= to:
                left[0].append(ids_a[i])
                at, i = at + len(of_a[i]), i + 1
            else:
                left[1].append(ids_b[j])
                to, j = to + len(of_b[j]), j + 1
            if at == to:
                groups.append(left)
                left = [[], []]
        links = collections.Counter((x, y) for g in groups for x in g[0] for y in g[1])
        count.update(links.keys())
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        found.append((doc, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(((d, n, m, g, sum(k.values()), sum(c for p, c in k.items() if count[p] == best[p[0]]), sum(c * count[p] for p, c in k.items()), h) for d, n, m, g, k, h in found), key=repr)


def test_op11_equals_plain(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in align.op11(df).collect()), key=repr) == plain(rows)


ODD = [None, "", " ", "  lead", "trail ", "a  b", "a\n b", "a\n\n b\tc", "<|endoftext|> x <s> y", "<0x0A> z", "x ▁y", "日本語 テスト", "é ́x", "a  b", "a  b", "it's 's 'll x's", "\U0001f600 \U0001f468‍\U0001f469", "\x00a b\x1c c", "====  ====", "abc123 a's&&& x-y'll! (Ünï) e\u0301! a_b i18n C++ né?e", "word " * 300, "x" * 5000, "  a", "= " * 40 + "== === ====="]


def test_op11_on_odd_texts(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (3, "a b"), (3, "a b"), (None, None)]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], f"{DOCS}, pairs INT, row STRING")
    for hot in (align.HOT, 4):
        monkeypatch.setattr(align, "HOT", hot)
        assert sorted((tuple(r) for r in align.op11(df).collect()), key=repr) == plain(rows)
    assert align.op11(df.limit(0)).collect() == []


@pytest.mark.parametrize("text", [t for t in ODD if t] + ["The end. It's 3 o'clock -- no?\r\n Yes  'tis 100% x@y.z"])
def test_units_give_the_ids_of_whole_texts(text):
    tools = align.pair(*map(public_tokenizers.path, align.VOCABULARIES))
    units = tools.cut(text)
    assert "".join(units) == f" {text}"
    assert [i for u in units for i in tools.a.encode(u, add_special_tokens=False).ids] == tools.a.encode(f" {text}", add_special_tokens=False).ids
    assert [i for x in tools.ids_b(units) for i in x] == tools.b.encode(text)


def test_groups_in_writing(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    got = {r.doc_id: r for r in align.align(df, written=True).collect()}
    assert got[1].groups.count("|") == got[1].n_groups and got[2].groups == "" and got[2].pairs == []
