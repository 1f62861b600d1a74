"""Order MinHash fingerprints: minimal occurrence-numbered k-mers, kept in text order and hashed as tuples."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdictlake.llm.common import stable

#: Length of a k-mer in code points, k-mers in a tuple, and tuples in a fingerprint.
K, TUPLE, SLOTS = 6, 2, 32
SEED = 20_240_601
#: k-mers that a slot's threshold lets through on average, as a multiple of TUPLE; too few leads to a full selection.
SLACK = 8
BLOCK = 1 << 17

_U = np.uint64
GOLD, MIX = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * MIX
    x = (x ^ (x >> _U(29))) * GOLD
    return x ^ (x >> _U(32))


@lru_cache
def _constants(slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A slot's odd multiplier, which orders 32-bit hashes, and the salt of its tuples."""
    odd = np.random.default_rng(seed).integers(0, 1 << 31, size=slots, dtype=np.uint32) << np.uint32(1) | np.uint32(1)
    return odd, _mixed(odd.astype(np.uint64))


def occurrences(codes: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each k-mer with its occurrence number, and its place; a text shorter than k is one k-mer."""
    n = len(codes) - k + 1
    c = codes.astype(np.uint64) + _U(1)
    if n < 1:
        h = np.array([int(np.bitwise_xor.reduce(_mixed(c + np.arange(1, len(c) + 1, dtype=np.uint64) * GOLD)))], dtype=np.uint64)
        return _mixed(h), np.zeros(1, dtype=np.int64)
    h = c[:n].copy()
    for j in range(1, k):
        h *= GOLD
        h += c[j : j + n]
    h = _mixed(h)
    key = h >> _U(24)  # k-mers whose upper 40 bits are equal count as one, in texts of any length
    if n < 1 << 24:  # hash and place fit in one word: a plain sort puts equal k-mers together in text order
        order = (key << _U(24)) | np.arange(n, dtype=np.uint64)
        order.sort()
        key, place = order >> _U(24), (order & _U((1 << 24) - 1)).astype(np.int64)
    else:
        place = np.argsort(key, kind="stable")
        key = key[place]
    at = np.arange(n)
    begins = np.empty(n, dtype=bool)
    begins[0] = True
    np.not_equal(key[1:], key[:-1], out=begins[1:])
    number = at - np.maximum.accumulate(np.where(begins, at, 0))
    z = h[place]
    again = number > 0
    if again.any():
        z[again] = _mixed(z[again] + number[again].astype(np.uint64) * MIX)
    return z, place


def fingerprint(text: str, k: int = K, size: int = TUPLE, slots: int = SLOTS, seed: int = SEED) -> np.ndarray:
    """`slots` hashes (uint32) of a text. Empty text gives zeros.

    A slot orders the occurrence-numbered k-mers by its own hash, takes the `size` smallest (all, if there are
    fewer), puts them in text order and hashes that tuple.
    """
    if not text:
        return np.zeros(slots, dtype=np.uint32)
    z, place = occurrences(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), k)
    odd, salt = _constants(slots, seed)
    n, take = len(z), min(size, len(z))
    short = (z >> _U(32)).astype(np.uint32)
    limit = np.uint32(min((1 << 32) - 1, int((1 << 32) * min(1.0, SLACK * size / n))))
    picked = np.empty((slots, take), dtype=np.int64)
    step = max(1, BLOCK // n)
    for lo in range(0, slots, step):
        v = np.multiply.outer(odd[lo : lo + step], short)
        hit = np.flatnonzero(v <= limit)
        row = hit // n
        by = np.argsort((row << 32) | v.ravel()[hit], kind="stable")
        found = np.bincount(row, minlength=len(v))
        if found.min() >= take:
            first = np.cumsum(found) - found
            picked[lo : lo + len(v)] = (hit - row * n)[by][first[:, None] + np.arange(take)]
        else:
            for r in range(len(v)):
                picked[lo + r] = np.argsort(v[r], kind="stable")[:take]
    picked = np.take_along_axis(picked, np.argsort(place[picked], axis=1), axis=1)
    out = salt.copy()
    for j in range(take):
        out = _mixed(out * GOLD + z[picked[:, j]])
    return (out >> _U(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of slots with equal tuples."""
    return float(np.count_nonzero(a == b)) / len(a)


def written(marks: np.ndarray) -> str:
    return marks.astype(">u4").tobytes().hex()


def edited(text: str, after: str) -> str:
    """The text with its last third (rounded down) replaced by as much of another's start, or all of that."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("edge", pa.int32()), ("text", pa.string())]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, edge int, text string"
#: Values of edge: a finished row, the first document of a part, the last one, which waits for the next part's first.
DONE, FIRST, LAST = 0, 1, 2


def _row(doc_id: int | None, text: str, marks: np.ndarray, after: str, marks_after: np.ndarray) -> tuple:
    new = edited(text, after)
    other = fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), written(marks), written(other), likeness(marks, other), likeness(marks, marks_after)


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def compare_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, its edited text, and how near it is to both that and the next document.

    The next document has the next smaller doc_id (after the last: the first); nulls come last, equal ids in the
    order of their texts. Null text counts as empty: its fingerprint is all zeros and equals only that of another
    empty text. Repeated rows are documents of their own; an empty table gives an empty result; other columns are
    not read. Texts are range-partitioned once and each task walks its range; what is left over, the last and the
    first document of each task, meets in a join of one row per task.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                marks = fingerprint(text)
                if held is None:
                    rows.append((doc_id, len(text), None, None, None, None, None, part, FIRST, text))
                else:
                    rows.append((*_row(*held, text, marks), part, DONE, None))
                held = doc_id, text, marks
            if rows:
                yield _batch(rows, FIELDS)
        if held is not None:
            yield _batch([(held[0], len(held[1]), None, None, None, None, None, part, LAST, held[1])], FIELDS)

    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()]
    walked = docs.select("doc_id", "text").repartitionByRange(order[0]).sortWithinPartitions(*order).mapInArrow(walk, SCHEMA)
    walked = stable(walked, "omh-walk")

    first = walked.where(F.col("edge") == FIRST).select(F.col("part").alias("next"), F.col("text").alias("after"))
    parts = first.select("next")
    following = parts.select(F.col("next").alias("part"), F.lead("next").over(Window.orderBy("next")).alias("next"))  # a row per task
    start = parts.agg(F.min("next").alias("start"))
    following = following.join(F.broadcast(start)).select("part", F.coalesce("next", "start").alias("next"))  # start: one row
    edges = walked.where(F.col("edge") == LAST).select("doc_id", "text", "part").join(following, "part").join(first, "next").select("doc_id", "text", "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(d, t, fingerprint(t), a, fingerprint(a)) for d, t, a in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield _batch(rows, FIELDS[:7])

    columns = [n for n, _ in FIELDS[:7]]
    closed = edges.mapInArrow(close, SCHEMA.partition(", part")[0])
    return walked.where(F.col("edge") == DONE).select(*columns).unionByName(closed)


def op9(docs: DataFrame) -> DataFrame:
    return compare_next(docs)
