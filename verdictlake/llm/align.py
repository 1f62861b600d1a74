"""Alignment of two tokenizers' ids over each text: groups between byte offsets where tokens of both end, and how good their links are over the corpus."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.common import give_back, stable
from verdictlake.llm.packing import gathered

VOCABULARIES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: Where a text may be cut so that no token of either kind crosses: before a single space between two other signs, and
#: between a Latin letter and an ASCII sign that is none.
LETTER, SIGN = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-@\[-`{-~]"
SPACE_CUT, CUT = re.compile(r"(?<=\S)(?= \S)"), re.compile(rf"(?<=\S)(?= \S)|(?<={LETTER})(?={SIGN})")
#: Bytes of the texts that are dealt with together; units that a worker keeps, and the longest of those.
TOGETHER, KEPT, KEPT_BYTES = 1 << 21, 1 << 17, 64
#: Links of a group that are listed one by one before they are counted.
EXPANDED = 1 << 10
#: Pairs in more than a HOT-th of all rows are joined by a broadcast: there are at most HOT of them.
HOT = 1 << 16
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
SCHEMA = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, pairs array<long>, links array<long>"
NO_LINKS = (0, 0, 0, 0, "", b"", b"")


def byte_alphabet() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 signs for themselves, then others in order from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers. A text is encoded by units that no token crosses, each of them once while it is kept.

    Units are exact where the first vocabulary splits texts before a single space and after letters, as byte-level ones
    do, and in the second the sign for a space only starts pieces and no piece goes on after a letter with another
    sign; else texts are cut at spaces only, or not at all.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        signs = byte_alphabet()
        self.bytes_a = {i: bytes(signs[c] for c in t) if all(c in signs for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        self.written = [str(i) for i in range(max(len(self.size_a), len(self.size_b)))]
        apart = "ByteLevel" in str(self.a.pre_tokenizer) and self.a.normalizer is None and not any("▁" in p.lstrip("▁") for p in pieces)
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        inside = apart and not any(re.search(LETTER + SIGN, p) for p in plain) and len(self.b.encode("x")) == 1
        self.cuts = CUT if inside else SPACE_CUT if apart else None
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def cut(self, text: str) -> list[str]:
        """The units of a space and the text."""
        return self.cuts.split(f" {text}") if self.cuts else [f" {text}"]

    def ids_b(self, units: list[str]) -> list[list[int]]:
        """The second tokenizer's ids; it puts a space before a text, so a unit without one stands after a letter that is taken off again."""
        ids = self.b.encode([u[1:] if u[0] == " " else f"x{u}" for u in units], num_threads=1)
        return [x if u[0] == " " else x[1:] for u, x in zip(units, ids, strict=True)]

    def aligned(self, units: list[str]) -> list[tuple | None]:
        """For each unit: n_a, n_b, n_groups, n_links, the groups in writing, and links with how often each occurs, as bytes of integers; null if the bytes differ.

        The units' bytes lie one after another, so two dictionaries from ends to places serve all of them: both
        tokenizers end a token at the end of a unit.
        """
        ids_a = [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)]
        ids_b = self.ids_b(units)
        raw = [u.encode() for u in units]
        said = lambda ids, of: b"\0".join([b"".join([of[i] for i in x]) for x in ids])
        if said(ids_a, self.bytes_a) == said(ids_b, self.bytes_b) == b"\0".join(raw) and not any(b"\0" in r for r in raw):
            return self._groups(ids_a, ids_b, raw)
        same = [b"".join(map(self.bytes_a.__getitem__, x)) == r == b"".join(map(self.bytes_b.__getitem__, y)) for x, y, r in zip(ids_a, ids_b, raw, strict=True)]
        ids_a, ids_b, raw = ([x for x, ok in zip(xs, same, strict=True) if ok] for xs in (ids_a, ids_b, raw))
        found = iter(self._groups(ids_a, ids_b, raw))
        return [next(found) if ok else None for ok in same]

    def _groups(self, ids_a: list[list[int]], ids_b: list[list[int]], raw: list[bytes]) -> list[tuple]:
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        at_a, at_b = (dict(zip(np.cumsum(size[ids]).tolist(), range(1, len(ids) + 1), strict=True)) for size, ids in ((self.size_a, a), (self.size_b, b)))
        common = sorted(at_a.keys() & at_b.keys())
        to_a, to_b = (np.fromiter(map(at.__getitem__, common), np.int64, len(common)) for at in (at_a, at_b))
        of_a, of_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        from_a, from_b, links = to_a - of_a, to_b - of_b, of_a * of_b
        said_a, said_b = ([self.written[i] for i in ids.tolist()] for ids in (a, b))
        groups = [f"{said_a[x]}|{said_b[y]}" if n == 1 else f"{','.join(said_a[x:p])}|{','.join(said_b[y:q])}" for x, y, p, q, n in zip(from_a.tolist(), from_b.tolist(), to_a.tolist(), to_b.tolist(), links.tolist(), strict=True)]
        pairs, times, of = self._links(a, b, from_a, from_b, of_a, of_b)
        ends = np.searchsorted(common, np.cumsum([len(r) for r in raw]), "right")
        linked = np.searchsorted(of, ends)
        total = np.diff(np.concatenate(([0], np.cumsum(links)))[ends], prepend=0).tolist()
        out, low, first = [], 0, 0
        for x, y, n, high, last in zip(ids_a, ids_b, total, ends.tolist(), linked.tolist(), strict=True):
            out.append((len(x), len(y), high - low, n, ";".join(groups[low:high]), pairs[first:last].tobytes(), times[first:last].tobytes()))
            low, first = high, last
        return out

    @staticmethod
    def _links(a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of ids, how often each is linked, and their group, by group: all of a group's ids on one side with all on the other."""
        links = of_a * of_b
        small = np.flatnonzero(links <= EXPANDED)
        n = links[small]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(of_b[small], n)
        pairs = a[np.repeat(from_a[small], n) + k // wide] << 32 | b[np.repeat(from_b[small], n) + k % wide]
        times, group = np.ones(len(pairs), np.int64), np.repeat(small, n)
        large = np.flatnonzero(links > EXPANDED)  # of these each different pair once
        more = [(p << 32 | q, x * y, g) for g in large.tolist() for p, x in Counter(a[from_a[g] : from_a[g] + of_a[g]].tolist()).items() for q, y in Counter(b[from_b[g] : from_b[g] + of_b[g]].tolist()).items()]
        if more:
            pairs, times, group = (np.concatenate((x, np.array(y, np.int64))) for x, y in zip((pairs, times, group), zip(*more, strict=True), strict=True))
            order = np.argsort(group, kind="stable")
            pairs, times, group = pairs[order], times[order], group[order]
        return pairs, times, group

    def units(self, names: list[str]) -> list[tuple | None]:
        """aligned() of each unit; the ones of lately are remembered, in two generations."""
        found = {u: x for u in names if (x := self.young.get(u, 0)) != 0 or (x := self.old.get(u, 0)) != 0}
        new = [u for u in names if u not in found]
        for at in range(0, len(new), 1 << 14):
            found.update(zip(new[at : at + (1 << 14)], self.aligned(new[at : at + (1 << 14)]), strict=True))
        for u in names:
            if len(u) <= KEPT_BYTES:
                self.young[u] = found[u]
                if len(self.young) >= KEPT:
                    self.old, self.young = self.young, {}
        return [found[u] for u in names]


@lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _documents(tools: Pair, ids: pa.Array, texts: list[str | None], written: bool) -> pa.RecordBatch:
    """The rows of SCHEMA for some documents; with `written` the groups in place of their hash."""
    number: dict[str, int] = defaultdict(count().__next__)
    codes = [np.fromiter(map(number.__getitem__, u), np.int64, len(u)) for u in (tools.cut(t) if t else [] for t in texts)]
    units = tools.units(list(number))
    number.clear()
    bad = np.array([u is None for u in units], dtype=bool)
    codes = [c[:0] if bad[c].any() else c for c in codes]  # bytes that differ anywhere leave a text without tokens
    units = [u or NO_LINKS for u in units]
    texts_of = [u[4] for u in units]
    groups = [";".join([texts_of[c] for c in row.tolist()]) for row in codes]
    digests = [(g if written else hashlib.sha256(g.encode()).hexdigest()) if g else "" for g in groups]
    of = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    all_codes = np.concatenate(codes) if codes else np.empty(0, np.int64)
    counts = [np.bincount(of, weights=np.array([u[k] for u in units], dtype=np.float64)[all_codes], minlength=len(codes)).astype(np.int64) if units else np.zeros(len(codes), np.int64) for k in range(4)]
    once, times = np.unique(of * max(1, len(units)) + all_codes, return_counts=True)
    document, unit = np.divmod(once, max(1, len(units)))
    sizes = np.array([len(u[5]) // 8 for u in units], dtype=np.int64)
    names, local = np.unique(np.frombuffer(b"".join([u[5] for u in units]), np.int64), return_inverse=True)
    at, _ = gathered(np.arange(len(local)), sizes, unit)
    weight = np.frombuffer(b"".join([u[6] for u in units]), np.int64)[at] * np.repeat(times, sizes[unit])
    key = np.repeat(document, sizes[unit]) * max(1, len(names)) + local[at]
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    total = np.add.reduceat(weight, first) if len(first) else weight
    document, name = np.divmod(key[first], max(1, len(names)))
    offsets = pa.array(np.searchsorted(document, np.arange(len(codes) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (names[name], total)]
    fields = ["doc_id", *COUNTS, "groups_sha256", "pairs", "links"]
    return pa.RecordBatch.from_arrays([ids, *map(pa.array, counts), pa.array(digests, pa.string()), *lists], fields)


def _aligned(path_a: str, path_b: str, written: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = pair(path_a, path_b)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            ends = np.cumsum(texts.cast(pa.large_string()).fill_null("").to_pandas().str.len().to_numpy(dtype=np.int64)) if len(texts) else []
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
                yield _documents(tools, ids.slice(at, stop - at), texts.slice(at, stop - at).to_pylist(), written)
                at = stop
        give_back()

    return run


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def align(docs: DataFrame, paths: tuple[str, str] | None = None, written: bool = False) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, counts, the hash of the groups, and the document's different links.

    A text, a space before it, is encoded by both tokenizers; dictionaries from the byte offsets where tokens end to
    their places are intersected, and the sorted offsets that both have cut the ids into groups. `pairs` holds each
    linked pair of ids once, the first tokenizer's in the upper 32 bits, `links` how often it is linked: a group links
    all its ids of one side with all of the other. With `written`, groups_sha256 is named `groups` and holds them in
    writing (`a1,a2|b1;a3|b2`). Null and empty texts, and those whose tokens' bytes are not the text's, have no tokens:
    zeros, an empty string and no links. Repeated rows and null ids stay as they are; other columns are not read. A
    text of any length is one row, whole; memory grows with the longest.
    """
    path_a, path_b = paths or tuple(map(vocabulary, VOCABULARIES))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_aligned(path_a, path_b, written), SCHEMA)
    return out.withColumnRenamed("groups_sha256", "groups") if written else out


def judged(aligned: DataFrame) -> DataFrame:
    """Adds n_best and count_sum to align()'s rows, which have to be frozen in a table with a unique `row`.

    A pair's count is how many rows hold it; the best of an id of the first tokenizer are its pairs with the highest.
    Counting combines rows before the exchange. Counts come back by two joins: pairs that more than a HOT-th of all
    rows are, HOT at most, by broadcast; others, which have few rows each, by the pair.
    """
    held = aligned.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("n"))
    counts = held.groupBy("pair").agg(F.count("*").alias("c"))
    a = F.shiftright("pair", 32)
    counts = stable(counts, "align-pairs")
    best = counts.groupBy(a.alias("a")).agg(F.max("c").alias("most"))  # as many rows as the vocabulary has ids
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    counts = counts.withColumn("a", a).join(F.broadcast(best), "a").select("pair", "c", (F.col("c") == F.col("most")).alias("best"))
    hot = F.broadcast(counts.where(F.col("c") * HOT > total))
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("c")).alias("count_sum")]
    common = held.join(hot, "pair").groupBy("row").agg(*sums)
    rare = held.join(hot.select("pair"), "pair", "left_anti").join(counts.where(F.col("c") * HOT <= total), "pair").groupBy("row").agg(*sums)
    both = common.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.drop("pairs", "links").join(both, "row", "left").withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")}).drop("row")


def op11(docs: DataFrame) -> DataFrame:
    found = stable(align(docs).withColumn("row", F.monotonically_increasing_id()), "align-documents")
    return judged(found).select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")
