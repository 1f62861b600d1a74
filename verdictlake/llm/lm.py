"""A trigram language model by deleted interpolation: counts over all training texts, mixture weights by expectation-maximisation on a deleted part."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.common import discard, give_back, small_batches, stable

#: Training texts whose checksum has this remainder are deleted from the counts while the weights are learned.
PARTS, HELD_OUT, DELETED = 7, 2, 3
ORDER = 3
#: Tokens of a chunk (a longer text is a chunk of its own), and keys that are counted together.
CHUNK, TOGETHER = 1 << 19, 1 << 21
#: The end of a text, and what stands before its beginning; white space is no word.
END, BEGIN = (np.uint64(xxhash.xxh3_64_intdigest(b)) for b in (b" ", b"  "))
#: Buckets of context frequency: none, and one for each power of two.
BUCKETS = 65
ROUNDS, GAIN = 40, 1e-5
ZSTD = {"compression": "zstd"}

CHUNKS = "deleted boolean, doc_ids array<long>, parts array<int>, sizes array<int>, codes binary, words binary, tokens long, starts long"
KEYS = "bucket int, chunk long, deleted boolean, keys binary, n binary"
COUNTS = "bucket int, chunk long, deleted boolean, total binary, rest binary, tokens long, types long, rest_tokens long, rest_types long"
EVENTS = "k3 long, n3 long, k2 long, n2 long, k1 long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def packed(values: np.ndarray) -> bytes:
    """Integers, compressed with their bytes by place, so that the equal upper ones of small numbers vanish; their size in bytes comes first."""
    data = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    whole = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(whole, np.uint8).reshape(width, size // width).T).view(kind).reshape(-1)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of 64 bits for each pair of hashes, in order."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class _Builder:
    """Texts as numbers of their words, until there are enough for a chunk."""

    def __init__(self, deleted: bool) -> None:
        self.deleted = deleted
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count(1).__next__)
        self.ids, self.parts, self.sizes, self.codes, self.tokens = [], [], [], [], 0

    def add(self, doc_id: int | None, part: int, text: str | None) -> None:
        words = (text or "").encode().lower().split()  # of bytes, these know ASCII letters and white space only
        codes = np.zeros(len(words) + 1, np.uint32)
        codes[:-1] = np.fromiter(map(self.number.__getitem__, words), np.uint32, len(words))
        self.ids.append(doc_id)
        self.parts.append(part)
        self.sizes.append(len(codes))
        self.codes.append(codes)
        self.tokens += len(codes)

    def batch(self) -> pa.RecordBatch:
        words = np.array([END, *map(xxhash.xxh3_64_intdigest, self.number)], dtype=np.uint64)
        starts = sum(p != HELD_OUT for p in self.parts)
        lists = [pa.array([x], pa.list_(kind)) for x, kind in ((self.ids, pa.int64()), (self.parts, pa.int32()), (self.sizes, pa.int32()))]
        lists += [pa.array([packed(x)], pa.binary()) for x in (np.concatenate(self.codes), words)]
        out = pa.RecordBatch.from_arrays([pa.array([self.deleted]), *lists, pa.array([self.tokens]), pa.array([starts])], [c.split()[0] for c in CHUNKS.split(", ")])
        self.clear()
        return out


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    builders = [_Builder(False), _Builder(True)]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            for doc_id, part, text in zip(*(batch.column(i).slice(at, 512).to_pylist() for i in range(3)), strict=True):
                builder = builders[part == DELETED]
                builder.add(doc_id, part, text)
                if builder.tokens >= CHUNK:
                    yield builder.batch()
    for builder in builders:
        if builder.ids:
            yield builder.batch()
    give_back()


class _Chunk:
    """A chunk's tokens: the hashes of their words, and whether each token is counted."""

    def __init__(self, row: dict) -> None:
        sizes = np.asarray(row["sizes"])
        self.starts = np.cumsum(sizes) - sizes
        self.first = np.zeros(int(sizes.sum()), dtype=bool)
        self.first[self.starts] = True
        self.parts, self.sizes, self.ids = np.asarray(row["parts"]), sizes, row.get("doc_ids")
        self.trained = np.repeat(self.parts != HELD_OUT, sizes)
        self.words = unpacked(row["words"], np.uint64)[unpacked(row["codes"], np.uint32)]

    def grams(self) -> Iterator[np.ndarray]:
        """The hash of the n-gram that ends at each token, for orders from 1 to ORDER."""
        found = self.words
        yield found
        for _ in range(ORDER - 1):
            found = mixed(self.before(found, BEGIN), self.words)
            yield found

    def before(self, values: np.ndarray, begin: int) -> np.ndarray:
        """The value of each token's predecessor."""
        out = np.roll(values, 1)
        out[self.first] = begin
        return out


def _row(table: pa.Table | pa.RecordBatch, i: int) -> dict:
    return {c: table.column(c)[i].as_py() for c in table.schema.names}


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, where each different one starts in that order, and the number of the different one at each place of it."""
    order = np.argsort(keys)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _keys(order: int, buckets: int):
    """A chunk's different n-grams of an order with how often it counts them, dealt into buckets of the hash range, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = _row(batch, i)
                chunk, rows = _Chunk(row), []
                grams = next(islice(chunk.grams(), order - 1, None))
                by, first, _ = _places(grams)
                keys, n = grams[by[first]], np.add.reduceat(chunk.trained[by].astype(np.uint32), first, dtype=np.uint32)
                bounds = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
                for b, (low, high) in enumerate(pairwise(bounds.tolist())):
                    if high > low:
                        rows.append((b, row["chunk"], row["deleted"], packed(np.diff(keys[low:high], prepend=np.uint64(0))), packed(n[low:high])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], [c.split()[0] for c in KEYS.split(", ")])
        give_back()

    return run


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)


def _counted(table: pa.Table) -> pa.Table:
    """For each chunk's keys of a bucket the counts over all chunks, and over those that are not deleted where it is; a row with sums."""
    deleted = np.array(table.column("deleted").to_pylist(), dtype=bool)
    keys = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
    n = np.concatenate([unpacked(x, np.uint32) for x in table.column("n").to_pylist()]).astype(np.int64)
    sizes = np.array([len(k) for k in keys])
    order, first, number = _places(np.concatenate(keys))
    del keys
    kept = np.where(np.repeat(deleted, sizes), 0, n)
    sums = [np.add.reduceat(x[order], first) for x in (n, kept)]
    counts = []
    for x in sums:
        all_ = np.empty(len(n), np.uint64)
        all_[order] = x[number].astype(np.uint64)
        counts.append(np.split(all_, np.cumsum(sizes)[:-1]))
    bucket, chunks = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist()
    rest = [packed(x) if d else None for x, d in zip(counts[1], deleted, strict=True)]
    stats = [int(x) for s in sums for x in (s.sum(), np.count_nonzero(s))]
    arrays = [pa.array([bucket] * (len(chunks) + 1), pa.int32()), pa.array([*chunks, None], pa.int64()), pa.array([*deleted.tolist(), None], pa.bool_()), pa.array([*map(packed, counts[0]), None], pa.binary()), pa.array([*rest, None], pa.binary())]
    arrays += [pa.array([None] * len(chunks) + [x], pa.int64()) for x in stats]
    give_back()
    return pa.table(arrays, names=[c.split()[0] for c in COUNTS.split(", ")])


def _of_tokens(chunk: _Chunk, counts: pa.Table, column: str, starts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each token's counts by order (1 to 3), and those of its contexts (for orders 2 and 3): a context is an n-gram of one order less."""
    data, found = dict(zip(zip(counts.column("gram").to_pylist(), counts.column("bucket").to_pylist(), strict=True), counts.column(column).to_pylist(), strict=True)), []
    for k, grams in enumerate(chunk.grams(), 1):
        order, _, number = _places(grams)
        out = np.empty(len(grams), np.int64)
        out[order] = np.concatenate([unpacked(data[key], np.uint64) for key in sorted(data) if key[0] == k])[number]
        found.append(out)
    return found, [chunk.before(x, starts) for x in found[:2]]


def _events(starts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i in range(left.num_rows):
            (k1, k2, k3), (n2, n3) = _of_tokens(_Chunk(_row(left, i)), right, "rest", starts)
            out.append(pa.table([k3, n3, k2, n2, k1], names=[c.split()[0] for c in EVENTS.split(", ")]))
        give_back()
        return pa.concat_tables(out)

    return run


@dataclass
class Model:
    """Weights by bucket of context frequency (w3, w2), that of the word's own share (w1), and what they are of: tokens, types and texts of training."""

    w3: list[float]
    w2: list[float]
    w1: float
    tokens: int
    types: int
    starts: int

    def probability(self, k: list[np.ndarray], n: list[np.ndarray]) -> np.ndarray:
        """P(w | u v) = w3 ML(w | u v) + (1 - w3) (w2 ML(w | v) + (1 - w2) (w1 ML(w) + (1 - w1) / (types + 1)))."""
        p = self.w1 * k[0] / max(1, self.tokens) + (1 - self.w1) / (self.types + 1)
        for weights, hits, context in ((self.w2, k[1], n[0]), (self.w3, k[2], n[1])):
            weight = np.array(weights)[np.frexp(context.astype(np.float64))[1]]
            p = weight * hits / np.maximum(1, context) + (1 - weight) * p
        return p


def _scored(model: Model):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i in range(left.num_rows):
            row = _row(left, i)
            chunk = _Chunk(row)
            k, n = _of_tokens(chunk, right, "total", model.starts)
            base = np.log10((k[0] + 1) / (model.tokens + model.types + 1))
            sums = [np.add.reduceat(x, chunk.starts) for x in ((k[0] > 0).astype(np.int64), base, np.log10(model.probability(k, n)))]
            arrays = [pa.array(chunk.ids, pa.int64()), pa.array(chunk.parts == HELD_OUT), pa.array(chunk.sizes.astype(np.int64)), *map(pa.array, sums)]
            out.append(pa.table(arrays, names=[c.split()[0] for c in SCORES.split(", ")]))
        give_back()
        return pa.concat_tables(out)

    return run


def bucket(context: Column) -> Column:
    """The bucket of a context's frequency: 0 for none, then one for each power of two."""
    return F.when(context > 0, F.length(F.bin(context))).otherwise(0)


def weights(events: DataFrame, tokens: int, types: int, rounds: int = ROUNDS, gain: float = GAIN) -> tuple[list[float], list[float], float]:
    """w3, w2 and w1 that make the held-out events (k3, n3, k2, n2, k1, n) most likely, by expectation-maximisation.

    Each round is one aggregate over the events with a row for each pair of buckets at most. Contexts without counts
    have weight 0; a bucket without events keeps one half. Rounds end when the likelihood of a token rises by less than `gain`.
    """
    w3, w2, w1, last = [0.0] + [0.5] * (BUCKETS - 1), [0.0] + [0.5] * (BUCKETS - 1), 0.5, -math.inf
    share = lambda k, n: F.when(F.col(n) > 0, F.col(k) / F.col(n)).otherwise(0.0)
    seen = events.select(bucket(F.col("n3")).alias("b3"), bucket(F.col("n2")).alias("b2"), share("k3", "n3").alias("a3"), share("k2", "n2").alias("a2"), (F.col("k1") / max(1, tokens)).alias("a1"), "n")
    for _ in range(rounds):
        of = lambda w, b: F.get(F.array(*map(F.lit, w)), F.col(b))
        step = seen.withColumn("x3", of(w3, "b3")).withColumn("x2", of(w2, "b2"))
        step = step.withColumn("r1", F.lit(w1) * F.col("a1")).withColumn("p1", F.col("r1") + (1 - w1) / (types + 1))
        step = step.withColumn("r2", F.col("x2") * F.col("a2")).withColumn("p2", F.col("r2") + (1 - F.col("x2")) * F.col("p1"))
        step = step.withColumn("r3", F.col("x3") * F.col("a3")).withColumn("p", F.col("r3") + (1 - F.col("x3")) * F.col("p2"))
        left3 = (1 - F.col("x3")) / F.col("p")
        sums = {"r3": F.col("r3") / F.col("p"), "r2": left3 * F.col("r2"), "r1": left3 * (1 - F.col("x2")) * F.col("r1"), "rest": left3 * F.col("p2"), "low": left3 * (1 - F.col("x2")) * F.col("p1"), "fit": F.log10("p")}
        rows = step.groupBy("b3", "b2").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * c).alias(name) for name, c in sums.items()]).collect()
        whole = sum(r["n"] for r in rows)
        if not whole:
            break
        for w, b, hit, base in ((w3, "b3", "r3", "n"), (w2, "b2", "r2", "rest")):
            for k in {r[b] for r in rows} - {0}:
                of_bucket = sum(r[base] for r in rows if r[b] == k)
                w[k] = round(sum(r[hit] for r in rows if r[b] == k) / of_bucket, 9) if of_bucket else w[k]
        low = sum(r["low"] for r in rows)
        w1 = min(1 - 1e-9, round(sum(r["r1"] for r in rows) / low, 9)) if low else w1
        fit = sum(r["fit"] for r in rows) / whole
        if fit - last < gain:
            break
        last = fit
    return w3, w2, w1


def score(docs: DataFrame) -> tuple[DataFrame, Model]:
    """SCORES for each row of docs (doc_id, text) under a model learned from the training rows, and that model.

    Rows whose crc32(doc_id as text, nulls as none) has remainder HELD_OUT by PARTS are not learned from; of the
    others, those with remainder DELETED are left out of the counts while the weights are learned on them, and are
    counted in the model. Tokens are words with A-Z in lower case, then an end; two begins stand before the first.
    Null text counts as empty: its end is its one token. A word that training has not takes a share of the uniform
    part, so no probability is zero. Repeated rows count each time; an empty table gives no rows.

    Tasks number their texts' words and write chunks. A chunk's different n-grams, as hashes of 64 bits, go to buckets
    of the hash range, where they are counted over all chunks; the counts go back to the chunk, which then knows each
    token's counts and, as a context is an n-gram itself, its contexts'. So a frequent n-gram is one entry a chunk, no
    key is hot, and everything counted grows with the input.
    """
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % PARTS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.cast("int").alias("part"), "text")
    with small_batches(docs.sparkSession, 256):
        chunks = stable(texts.mapInArrow(_chunked, CHUNKS).withColumn("chunk", F.monotonically_increasing_id()), "lm-chunks", ZSTD)
    sums = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "starts", F.when(~F.col("deleted"), F.col("starts")))]).first()
    buckets = max(1, math.ceil(sums[0] / TOGETHER))
    counts, stats = None, []
    for order in range(1, ORDER + 1):  # one order after another, so that the keys of one at a time lie on disk
        keys = chunks.select("chunk", "deleted", "parts", "sizes", "codes", "words").mapInArrow(_keys(order, buckets), KEYS)
        with small_batches(docs.sparkSession, 16):
            found = stable(keys.groupBy("bucket").applyInArrow(_counted, COUNTS), f"lm-counts-{order}", ZSTD).withColumn("gram", F.lit(order))
        del keys
        stats.append(found.where("chunk IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "rest_tokens", "rest_types")]).first())
        counts = found if counts is None else counts.unionByName(found)
    if len({(x[0], x[2]) for x in stats}) > 1:
        raise RuntimeError(f"each token ends one n-gram of each order, but {stats} were counted")
    stats = stats[0]

    def of_chunks(rows: DataFrame, column: str, run, schema: str) -> DataFrame:
        left = rows.select("chunk", "doc_ids", "parts", "sizes", "codes", "words").groupBy("chunk")
        right = counts.where(F.col(column).isNotNull()).select("chunk", "gram", "bucket", column)
        return left.cogroup(right.groupBy("chunk")).applyInArrow(run, schema)

    events = of_chunks(chunks.where("deleted"), "rest", _events(sums[2]), EVENTS).groupBy("k3", "n3", "k2", "n2", "k1").agg(F.count("*").alias("n"))
    events = stable(events, "lm-events", ZSTD)
    model = Model(*weights(events, stats[2], stats[3]), tokens=stats[0], types=stats[1], starts=sums[1])
    discard(events)
    return of_chunks(chunks, "total", _scored(model), SCORES), model


def op12(docs: DataFrame) -> DataFrame:
    scored, model = score(docs)
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
