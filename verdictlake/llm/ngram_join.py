"""N-gram Jaccard join by prefix filters under several token orders, to components of linked documents.

Tokens are hashes of word 5-grams. A pair of sets that reaches the threshold shares a token of both sets' prefixes
under any order of all tokens, the first n - ceil(t * n) + 1 tokens of a set of n. Three orders are intersected:

* A, the hash itself. The join runs on A's prefix tokens that few sets hold.
* A', which puts frequent tokens last, for sets with prefix tokens of many (a passage of many documents, a large group
  of near copies). Frequent are tokens of bitmaps made from counts; any bitmap gives one order for all sets, so counts
  need not be complete.
* B, the hash from its upper end. A candidate of A or A' also has to share a token of B's prefixes, and what A's and
  B's prefixes leave of both sets has to suffice for the threshold, before whole sets are fetched and compared.

A token that many sets hold even under A' is never joined with itself. Its sets, split by size, are compared with one
lead each, the set with fewest tokens before the shared one. Whatever is still apart then has to pass the place filter:
a pair whose first shared token stands at places i and j shares at most min(na - i, nb - j).

Equal sets are one set from the start. Links are found in two rounds: each set is first compared with its most
promising partner, and only pairs whose sets are not connected by then are compared after that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.common import bitmap, bitmap_words, discard, give_back, in_bitmap, stable
from verdictlake.llm.components import components

#: Words of a shingle; the threshold as a percentage.
WORDS, PERCENT = 5, 80
#: A prefix token of more sets than this is joined under order A'.
HOT = 32
#: Frequent tokens are counted in this share of all hashes first, and past it only for sets that need more.
ZONE = 0.4
#: Bits of the filters that tasks get; a full filter lets all through and costs time, not links.
FILTER_BITS = 1 << 24

_U = np.uint64
_POWERS = np.array([pow(0x5851F42D4C957F2D, i, 1 << 64) for i in range(WORDS)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(32))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in parts of so many rows, so that what is made of a batch is never held whole."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's 5-word shingles; with fewer words, of all of them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(w) - WORDS + 1
    h = w[:n] * _POWERS[0]
    for j in range(1, WORDS):
        h += w[j : j + n] * _POWERS[j]
    return np.unique(_mixed(h))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def least_overlap(na: int, nb: int) -> int:
    """Tokens that sets of these sizes share at least, if they are linked."""
    return -(-PERCENT * (na + nb) // (100 + PERCENT))


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


#: Sets are written once and read several times; random hashes do not compress.
PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}


def token_sets(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), n (shingles), sid (a hash of the set, null if empty), head, body, for each row.

    head: A's prefix of the set. body: all other tokens. Both are sorted, and empty where another document with the
    same text holds them, the one of the smallest id; by bitmaps, so that a few more may hold them and none is lost.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    copied = stable(rows.groupBy("key").agg(F.count("*").alias("c"), F.min("doc_id").alias("doc_id")).where("c > 1").select("key", F.xxhash64("doc_id", "key").alias("one")), "join-copied")
    several, first = _filter(copied, "key"), _filter(copied, "one")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, one = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "one"))
            holds = (~in_bitmap(several.value, key) | in_bitmap(first.value, one)).tolist()
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            sid = [int(np.int64(_U(xxhash.xxh3_64_intdigest(s.tobytes())))) if len(s) else None for s in sets]
            n = pa.array([len(s) for s in sets], pa.int64())
            sets = [s.view(np.int64) if h else s[:0].view(np.int64) for s, h in zip(sets, holds, strict=True)]
            cut = [prefix_length(len(s)) for s in sets]
            head, body = [s[:c] for s, c in zip(sets, cut, strict=True)], [s[c:] for s, c in zip(sets, cut, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), n, pa.array(sid, pa.int64()), _lists(head, pa.int64()), _lists(body, pa.int64())], names=["doc_id", "key", "n", "sid", "head", "body"])

    rows = rows.withColumn("one", F.xxhash64("doc_id", "key"))
    return stable(rows.mapInArrow(run, "doc_id long, key long, n long, sid long, head array<long>, body array<long>"), "join-sets", PLAIN)


def _filter(tokens: DataFrame, column: str = "t"):
    """A broadcast bitmap of the lower bits of a column of hashes."""
    return tokens.sparkSession.sparkContext.broadcast(bitmap(tokens.select(F.col(column).bitwiseAND(FILTER_BITS - 1).alias("bit")), "bit", FILTER_BITS))


def shared_tokens(sets: DataFrame, column: str, name: str) -> tuple[DataFrame, object, object]:
    """Tokens (t, c) of c > 1 rows, and bitmaps of all of them and of those with c > HOT."""
    counts = sets.select(F.explode(column).alias("t")).groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    tokens = stable(counts, f"join-{name}-tokens")
    return tokens, _filter(tokens), _filter(tokens.where(F.col("c") > HOT))


def prefix_rows(sets: DataFrame, column: str, several, hot, crowded: bool) -> DataFrame:
    """A row (t, sid, n, pos, h) for each prefix token of few sets or, if `crowded`, of many.

    several, hot: bitmaps of tokens; of many is what the second holds. h: the set's prefix tokens of many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column("prefix")
            t, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            many = in_bitmap(hot.value, t.view(np.uint64))
            keep = many if crowded else in_bitmap(several.value, t.view(np.uint64)) & ~many
            ends = np.cumsum(size)
            pos = np.arange(len(t)) - np.repeat(ends - size, size)
            before = np.concatenate(([0], np.cumsum(many)))
            h = np.repeat(before[ends] - before[ends - size], size)
            sid, n = (np.repeat(batch.column(c).to_numpy(), size)[keep] for c in ("sid", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(sid), pa.array(n), pa.array(pos[keep].astype(np.int32)), pa.array(h[keep].astype(np.int32))], names=["t", "sid", "n", "pos", "h"])

    return sets.select("sid", "n", F.col(column).alias("prefix")).mapInArrow(run, "t long, sid long, n long, pos int, h int")


def _of_many(hot, heads: pa.Array) -> np.ndarray:
    """For each list of tokens, whether the bitmap holds one."""
    t, offsets = heads.flatten().to_numpy(), heads.offsets.to_numpy()
    held = np.concatenate(([0], np.cumsum(in_bitmap(hot.value, t.view(np.uint64)))))
    at = offsets - offsets[0]
    return held[at[1:]] > held[at[:-1]]


class _Order:
    """Order A' in a task: frequent tokens last, each part by hash. beyond is for hashes past ZONE only, or None."""

    def __init__(self, frequent, beyond) -> None:
        self.frequent, self.beyond, self.edge = frequent.value, beyond.value if beyond else None, _U(int(ZONE * (1 << 32)))

    def prefix(self, tokens: np.ndarray) -> np.ndarray | None:
        """The prefix of a sorted set, or None if it ends past ZONE and nothing is known of hashes there."""
        t = tokens >> _U(32)
        last, size = in_bitmap(self.frequent, t), prefix_length(len(tokens))
        if self.beyond is not None:
            last |= (t >= self.edge) & in_bitmap(self.beyond, t)
        elif np.count_nonzero(~last) < size or t[~last][size - 1] >= self.edge:
            return None
        return np.concatenate((tokens[~last], tokens[last]))[:size]


def _crowded_sets(batches: Iterator[pa.RecordBatch], hot) -> Iterator[tuple[int, int, np.ndarray]]:
    """(sid, length of A's prefix, sorted tokens) of the sets with a token of many sets in A's prefix."""
    for batch in slices(batches):
        batch = batch.filter(pa.array(_of_many(hot, batch.column("head"))))
        for sid, head, body in zip(batch.column("sid").to_pylist(), _arrays(batch.column("head")), _arrays(batch.column("body")), strict=True):
            yield sid, len(head), np.concatenate((head, body)).view(np.uint64)


def upper_halves(sets: DataFrame, hot, frequent=None) -> DataFrame:
    """Column t: upper 32 bits of tokens of sets in crowds: past A's prefix within ZONE, or past ZONE where A' needs to know of them."""
    edge = _U(int(ZONE * (1 << 32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _Order(frequent, None) if frequent is not None else None
        held, size = [], 0
        for _, cut, tokens in _crowded_sets(batches, hot):
            t = tokens >> _U(32)
            at = int(np.searchsorted(t, edge))
            if order is None or order.prefix(tokens) is None:
                held.append(t[cut:at] if order is None else t[at:])
                size += len(held[-1])
            if size > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).astype(np.int64))], names=["t"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).astype(np.int64))], names=["t"])

    return sets.select("sid", "head", "body").mapInArrow(run, "t long")


def reordered(sets: DataFrame, hot, frequent, beyond) -> DataFrame:
    """Prefixes under order A' (sid, n, prefix) of the sets with a token of many sets in A's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, full, rows = _Order(frequent, None), _Order(frequent, beyond), []

        def batch() -> pa.RecordBatch:
            sid, n, prefix = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(n, pa.int64()), _lists(list(prefix), pa.int64())], names=["sid", "n", "prefix"])

        for sid, _, tokens in _crowded_sets(batches, hot):
            prefix = near.prefix(tokens)
            rows.append((sid, len(tokens), (full.prefix(tokens) if prefix is None else prefix).view(np.int64)))
            if len(rows) == 256:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    return sets.select("sid", "head", "body").mapInArrow(run, "sid long, n long, prefix array<long>")


def close(na: Column, nb: Column) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * PERCENT


def in_place(na: Column, i: Column, nb: Column, j: Column) -> Column:
    """Whether sets whose first shared prefix token stands at places i and j can be linked."""
    return F.least(na - i, nb - j) * (100 + PERCENT) >= (na + nb) * PERCENT


def pairs_of(rows: DataFrame) -> DataFrame:
    """Pairs a < b, k of sets that share k prefix tokens of few sets and can still be linked; rows as of prefix_rows().

    A group is HOT sets at most, as the others' tokens are in the bitmap of tokens of many. Tokens of many in both
    prefixes are not in k, so as many as both can have are added to the bound.
    """
    groups = rows.groupBy("t").agg(F.collect_set(F.struct("sid", "n", "pos", "h")).alias("m")).where(F.size("m") > 1)
    one = groups.select("m", F.explode("m").alias("a"))
    fits = lambda b: (b["sid"] > F.col("a.sid")) & close(b["n"], F.col("a.n")) & in_place(b["n"], b["pos"], F.col("a.n"), F.col("a.pos"))
    two = one.select("a", F.explode(F.filter("m", fits)).alias("b"))
    both = two.groupBy(F.col("a.sid").alias("a"), F.col("b.sid").alias("b")).agg(
        F.count("*").alias("k"), F.max("a.pos").alias("i"), F.max("b.pos").alias("j"), F.min("a.n").alias("na"), F.min("b.n").alias("nb"), F.min(F.least("a.h", "b.h")).alias("h")
    )
    rest = F.col("k") + F.col("h") + F.least(F.col("na") - F.col("i") - 1, F.col("nb") - F.col("j") - 1)
    return both.where(rest * (100 + PERCENT) >= PERCENT * (F.col("na") + F.col("nb"))).select("a", "b", "k")


def fetch(sets: DataFrame, wanted: DataFrame, whole: bool) -> DataFrame:
    """Rows of the sets that pass a bitmap of the wanted sids: with `whole` sid, tokens, else sid, n, low, top.

    low, top: the upper 32 bits of A's and B's prefixes, in order. A set may come more than once.
    """
    bits = _filter(wanted, "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(pa.array(in_bitmap(bits.value, batch.column("sid").to_numpy().view(np.uint64))))
            if not batch.num_rows:
                continue
            tokens = [np.concatenate(x) for x in zip(_arrays(batch.column("head")), _arrays(batch.column("body")), strict=True)]
            if whole:
                yield pa.RecordBatch.from_arrays([batch.column("sid"), _lists(tokens, pa.int64())], names=["sid", "tokens"])
                continue
            cut = [prefix_length(len(x)) for x in tokens]
            low, top = ([_upper(f(x, c)) for x, c in zip(tokens, cut, strict=True)] for f in (lambda x, c: x[:c], lambda x, c: x[len(x) - c :]))
            yield pa.RecordBatch.from_arrays([batch.column("sid"), batch.column("n"), _lists(low, pa.int32()), _lists(top, pa.int32())], names=["sid", "n", "low", "top"])

    return stable(sets.select("sid", "n", "head", "body").mapInArrow(run, "sid long, tokens array<long>" if whole else "sid long, n long, low array<int>, top array<int>"), "join-fetched", PLAIN)


def _upper(hashes: np.ndarray) -> np.ndarray:
    """The upper 32 bits of hashes, as int32."""
    return (hashes.view(np.uint64) >> _U(32)).astype(np.uint32).view(np.int32)


def may_link(na: int, nb: int, low: tuple[np.ndarray, np.ndarray], top: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether sets can be linked, from the upper halves of their prefixes under A (low) and B (top), sorted uint32.

    They have to share a token under both orders. Tokens below the lesser end of both low prefixes, and above the
    greater beginning of both top ones, lie within the prefixes of either set, so what they share is known (or less
    than is counted, if upper halves coincide); of the rest they share what the smaller rest has at most.
    """
    (la, lb), (ta, tb) = low, top
    k_low, k_top = np.isin(la, lb), np.isin(ta, tb)
    if not k_low.any() or not k_top.any():
        return False
    end, start = min(la[-1], lb[-1]), max(ta[0], tb[0])
    xa, xb = (int(np.searchsorted(x, end)) for x in (la, lb))
    ya, yb = (len(y) - int(np.searchsorted(y, start, side="right")) for y in (ta, tb))
    known = int(np.count_nonzero(k_low[:xa])) + int(np.count_nonzero(k_top[len(ta) - ya :]))
    return known + min(na - xa - ya, nb - xb - yb) >= least_overlap(na, nb)


def linked(pairs: DataFrame, ends: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are linked: prefixes under A and B first, then all tokens of what is left.

    ends: the prefixes, as fetch() gives them, of all sets of the pairs. full: the token sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            na, nb = (batch.column(c).to_pylist() for c in ("na", "nb"))
            low, top = (zip(*([x.view(np.uint32) for x in _arrays(batch.column(f"{c}{s}"))] for s in "ab"), strict=True) for c in ("low_", "top_"))
            keep = pa.array([may_link(*x) for x in zip(na, nb, low, top, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    def side(table: DataFrame, s: str, *columns: str) -> DataFrame:
        return table.select(F.col("sid").alias(s), *(F.col(c).alias(f"{c}_{s}" if c != "n" else f"n{s}") for c in columns))

    first = pairs.select("a", "b").join(side(ends, "a", "n", "low", "top"), "a").join(side(ends, "b", "n", "low", "top"), "b")
    left = stable(first.select("a", "b", "na", "nb", "low_a", "low_b", "top_a", "top_b").mapInArrow(run, "a long, b long"), "join-candidates")
    sets = fetch(full, left.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), whole=True)
    both = left.distinct().join(side(sets, "a", "tokens"), "a").join(side(sets, "b", "tokens"), "b")
    k = F.size(F.array_intersect("tokens_a", "tokens_b"))
    links = stable(both.where(k * 100 >= PERCENT * (F.size("tokens_a") + F.size("tokens_b") - k)).select("a", "b").distinct(), "join-links")
    discard(sets)
    return links


def _best(pairs: DataFrame) -> DataFrame:
    """Each set's partner with most shared prefix tokens."""
    ways = pairs.select("a", "b", "k").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "k"))
    best = ways.groupBy("a").agg(F.max(F.struct("k", "b")).alias("x"))
    return best.select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b")).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs that labels (node, root) do not connect yet."""
    one = pairs.join(labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
    two = one.join(labels.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    return two.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def crowds(rows: DataFrame) -> DataFrame:
    """Rows (t, sid, n, pos, band) of tokens of many sets; sets of neighbouring bands only can be linked."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT)) + 1e-9).cast("int")
    return stable(rows.dropDuplicates(["t", "sid"]).select("t", "sid", "n", "pos", band.alias("band")), "join-crowds")


def _stars(members: DataFrame) -> DataFrame:
    """For sets in crowds: the lead that most of their tokens have in their band, and pairs of neighbouring bands' leads."""
    lead = members.groupBy("t", "band").agg(F.min(F.struct(F.col("pos") / F.col("n"), "sid")).alias("x")).select("t", "band", F.col("x.sid").alias("lead"))
    ways = members.join(lead, ["t", "band"]).where("sid <> lead").groupBy("sid", "lead").agg(F.count("*").alias("k"))
    best = ways.groupBy("sid").agg(F.max(F.struct("k", "lead")).alias("x")).select("sid", F.col("x.lead").alias("lead"))
    next_ = lead.select("t", (F.col("band") + 1).alias("band"), F.col("lead").alias("sid")).join(lead, ["t", "band"]).where("sid <> lead").select("sid", "lead")
    return best.unionByName(next_).select(F.least("sid", "lead").alias("a"), F.greatest("sid", "lead").alias("b")).distinct()


def _crossing(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of sets in crowds that are not connected yet and can be linked by their places.

    Within a token, the component with most sets is joined with the others only, so a token whose sets are connected
    gives no pair.
    """
    known = members.join(labels.select(F.col("node").alias("sid"), "root"), "sid", "left").select("t", "sid", "n", "pos", "band", F.coalesce("root", "sid").alias("c"))
    known = stable(known, "join-known")
    size = known.groupBy("t", "c").agg(F.count("*").alias("s"))
    main = size.groupBy("t").agg(F.max(F.struct("s", "c")).alias("x"), F.count("*").alias("cs")).where("cs > 1").select("t", F.col("x.c").alias("most"))
    mixed = stable(known.join(main, "t"), "join-mixed")
    few = mixed.where("c <> most").select("t", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))).alias("band"), F.struct("sid", "n", "pos", "c").alias("a"))
    both = few.join(mixed.select("t", "band", F.struct("sid", "n", "pos", "c").alias("b")), ["t", "band"])
    both = both.where((F.col("a.c") != F.col("b.c")) & close(F.col("a.n"), F.col("b.n")) & in_place(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos")))
    return both.select(F.least("a.sid", "b.sid").alias("a"), F.greatest("a.sid", "b.sid").alias("b")).distinct()


def found_links(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), n, sid and root for each row; rows of one root are connected, a null root stands alone."""
    sets = token_sets(docs)
    full = sets.where(F.size("head") > 0)

    # Order A: tokens of few sets.
    tokens, several, hot = shared_tokens(full, "head", "prefix")
    cold = pairs_of(prefix_rows(full, "head", several, hot, crowded=False))

    # Order A', for sets with tokens of many: counts within ZONE, and past it where prefixes do not end before.
    often = tokens.where(F.col("c") > HOT).select(F.shiftrightunsigned("t", 32).alias("t"))
    zone = upper_halves(full, hot).groupBy("t").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("t")
    frequent = _filter(often.unionByName(zone))
    beyond = _filter(upper_halves(full, hot, frequent).groupBy("t").agg(F.count("*").alias("c")).where(F.col("c") > HOT))
    again = stable(reordered(full, hot, frequent, beyond), "join-again", PLAIN)
    _, several_, hot_ = shared_tokens(again, "prefix", "again")
    members = crowds(prefix_rows(again, "prefix", several_, hot_, crowded=True))

    pairs = cold.unionByName(pairs_of(prefix_rows(again, "prefix", several_, hot_, crowded=False)))
    pairs = stable(pairs.groupBy("a", "b").agg(F.sum("k").alias("k")), "join-pairs")
    discard(again)
    wanted = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).unionByName(members.select("sid")).distinct()
    ends = fetch(full, wanted, whole=False)

    links = linked(_best(pairs).unionByName(_stars(members)).distinct(), ends, full)
    labels = stable(components(links), "join-labels")
    rest = stable(_apart(pairs, labels).unionByName(_crossing(members, labels)).distinct(), "join-rest")
    labels = stable(components(links.unionByName(linked(rest, ends, full))), "join-labels")
    discard(ends)

    found = stable(sets.select("doc_id", "key", "n", "sid"), "join-documents")
    discard(sets)
    return found.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", "key", "n", "sid", F.coalesce("root", "sid").alias("root"))


def link_components(docs: DataFrame) -> DataFrame:
    """A row (doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    component_id is the smallest doc_id that the document reaches by links. Null and blank texts have no shingles and
    link with nothing, so each is its own component; repeated rows are copies of each other; a null doc_id takes
    part and never names a component unless all its documents' ids are null. An empty table gives an empty result.
    Hashes of 64 bits stand for shingles and sets.
    """
    found = stable(found_links(docs), "join-found")
    least = found.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = found.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, null last.

    Of repeated rows (equal id and text) one stays, whatever their other columns hold. Rows without words link with
    nothing and all stay. Two different texts under one id are told apart by their text.
    """
    found = stable(found_links(docs), "join-found").where("root IS NOT NULL")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    first = found.groupBy("root").agg(F.min(rank).alias("x"), F.count("*").alias("rows")).where("rows > 1").select("root", "x")
    rows = stable(found.join(first, "root").select("doc_id", "key", (rank == F.col("x")).alias("stays")), "join-verdicts")
    gone = rows.where("NOT stays").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    twice = rows.where("stays").groupBy("doc_id", "key").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    # Texts of rows that a bitmap of both tables does not hold travel nowhere.
    bit = lambda id_, key: F.xxhash64(id_, key).bitwiseAND(FILTER_BITS - 1)
    named = stable(gone.unionByName(twice).select(bit("_id", "_key").alias("bit")), "join-named")
    words = F.broadcast(bitmap_words(named, "bit").select(F.col("w").alias("_w"), F.col("v").alias("_v")))  # FILTER_BITS / 32 rows at most
    at = bit(F.col("doc_id"), F.xxhash64("text"))
    marked = docs.withColumn("_bit", at).join(words, F.shiftright("_bit", 5) == F.col("_w"), "left")
    held = F.coalesce(F.expr("shiftright(_v, CAST(_bit & 31 AS INT)) & 1"), F.lit(0)) == 1
    others, maybe = (marked.where(x).select(*docs.columns) for x in (~held, held))
    kept = maybe.join(gone, same, "left_anti")
    once = kept.join(twice, same, "left_semi").withColumn("_key", F.xxhash64("text")).dropDuplicates(["doc_id", "_key"]).drop("_key")
    return others.unionByName(kept.join(twice, same, "left_anti")).unionByName(once)


def op2(docs: DataFrame) -> DataFrame:
    return link_components(docs)
