"""Best-fit packing of tokenised documents by linear grouping, planned on the histogram of lengths.

A plan's input is the number of pieces of each length, at most one number for each length up to the capacity, so
it is bounded whatever the corpus. Everything that touches documents (tokenising, ranking pieces of a length,
looking up a piece's place) runs on Spark.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdictlake.llm.common import small_batches, stable

CAPACITY = 2048
END = 0
VOCABULARY = "word_bpe_49k.json"
#: Lengths above capacity / SMALL are grouped; groups of large pieces.
SMALL, GROUPS = 8, 64
#: A word of letters, with ASCII punctuation after it but for the apostrophe, which can start a suffix of its own. U+0130
#: has no single letter as its lower case.
LETTERS = r"^(?P<stem>[^\P{L}\x{130}]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"
#: Words of letters that are encoded in one run; bytes of the texts that are looked up together; words that a worker keeps.
RUN, TOGETHER, KEPT = 256, 1 << 23, 1 << 20

PIECES = "doc_id long, part int, piece int, start long, length int, ids_crc32 long, place long"


def gathered(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists number `which`, one after another, and their ends, of lists that lie one after another in values."""
    starts, count = np.cumsum(sizes) - sizes, sizes[which]
    ends = np.cumsum(count)
    return values[np.repeat(starts[which] - ends + count, count) + np.arange(count.sum())], ends


class WordIds:
    """Token ids of texts through a tokenizer, word by word: exact, as no token of this vocabulary spans white space.

    Arrow splits texts and numbers their different words. A word of letters is one unit before merges, and what
    punctuation follows it another, so different stems are encoded in runs of RUN, and tails by themselves.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.kept = (pa.array([], pa.string()), np.empty(0, np.uint32), np.empty(0, np.int64))

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        found = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint32), *found]), np.array([len(x) for x in found], dtype=np.int64)

    def _encode_letters(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Like _encode for words of letters, a run a call; a run that does not fall into its words is encoded by words."""
        at = np.append(np.arange(0, len(words), RUN), len(words)).astype(np.int32)
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), words), " ").to_pylist()
        ids, sizes = self._encode(runs)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        cuts = np.cumsum(sizes)
        if np.array_equal(np.searchsorted(ends, cuts, side="right"), at[1:]):
            return ids, np.diff(ends, prepend=0)
        parts = []
        for i, run in enumerate(runs):
            own = ids[cuts[i] - sizes[i] : cuts[i]]
            stops = np.flatnonzero(self.ends_word[own]) + 1
            parts.append((own, np.diff(stops, prepend=0)) if len(stops) == at[i + 1] - at[i] else self._encode(run.split(" ")))
        return tuple(map(np.concatenate, zip(*parts, strict=True)))

    def _stems(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Like _encode_letters for different words; the last KEPT or so are not encoded again."""
        kept, ids, sizes = self.kept
        at = pc.index_in(words, value_set=kept)
        new = words.filter(at.is_null())
        new_ids, new_sizes = self._encode_letters(new)
        kept, ids, sizes = pa.concat_arrays([kept, new]), np.concatenate((ids, new_ids)), np.concatenate((sizes, new_sizes))
        place = at.fill_null(-1).to_numpy(zero_copy_only=False)
        place = np.where(place < 0, len(kept) - len(new) - 1 + np.cumsum(place < 0), place)
        drop = len(kept) - KEPT // 2 if len(kept) > KEPT else 0
        self.kept = (pa.concat_arrays([kept[drop:]]), ids[int(sizes[:drop].sum()) :].copy(), sizes[drop:].copy()) if drop else (kept, ids, sizes)
        return gathered(ids, sizes, place)[0], sizes[place]

    def _words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words, and how many each has."""
        parts = pc.extract_regex(words, LETTERS)
        lone = parts.is_null()
        stems, tails = (pc.struct_field(parts, n).dictionary_encode() for n in ("stem", "tail"))
        units = [self._stems(stems.dictionary), self._encode(tails.dictionary.to_pylist()), self._encode(words.filter(lone).to_pylist())]
        ids, sizes = map(np.concatenate, zip(*units, strict=True))
        lone = lone.to_numpy(zero_copy_only=False)
        first, second = (np.where(lone, 0, x.indices.fill_null(0).to_numpy(zero_copy_only=False)) for x in (stems, tails))
        first[lone] = len(stems.dictionary) + len(tails.dictionary) + np.arange(np.count_nonzero(lone))
        second = np.where(lone, len(sizes), second + len(stems.dictionary))
        sizes = np.append(sizes, 0)  # a word without a tail of its own
        both, _ = gathered(ids, sizes, np.stack((first, second), axis=1).ravel())
        return both, sizes[first] + sizes[second]

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where in it each text begins and ends."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids, sizes = self._words(words.dictionary)
        found, ends = gathered(ids, sizes, words.indices.to_numpy(zero_copy_only=False))
        return found, np.append(0, ends)[split.offsets.to_numpy() - split.offsets[0].as_py()]


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for each worker process: tasks that follow one another share it."""
    return WordIds(path)


def coded(texts: pa.Array, ids_of: WordIds) -> Iterator[np.ndarray]:
    """The ids of each text, with no more than TOGETHER bytes and a text looked up at once."""
    texts = texts.cast(pa.string()).fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER)))
        ids, cuts = ids_of(texts.slice(at, stop - at))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield ids[a:b]
        at = stop


def tokenised(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each document's ids followed by END: part, piece, start, length, crc32, and place among its length's in part.

    A part is a task of this job; the result is frozen, so places stay what they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, ids_of = TaskContext.get().partitionId(), {}, word_ids(path or tokenizer_path())
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), coded(batch.column(1), ids_of), strict=True):
                data = ids.astype("<u4").tobytes() + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    cut = data[at : at + 4 * capacity]
                    length = len(cut) // 4
                    place = seen.get(length, 0)
                    seen[length] = place + 1
                    rows.append((doc_id, part, piece, at // 4, length, zlib.crc32(cut), place))
            if rows:
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "part", "piece", "start", "length", "ids_crc32", "place"])

    with small_batches(docs.sparkSession, 2048):
        return stable(docs.select("doc_id", "text").mapInArrow(run, PIECES), "pack-pieces")


def groups_of(counts: dict[int, int], low: int, groups: int) -> list[list[tuple[int, int]]]:
    """Large lengths, longest first, in groups of equal cardinality: [(length, pieces), ...] each."""
    large = sorted(((n, c) for n, c in counts.items() if n > low), reverse=True)
    total = sum(c for _, c in large)
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length, count in large:
        while count:
            if room == 0:
                out.append([])
                room = -(-total // groups)
            took = min(count, room)
            out[-1].append((length, took))
            count, room = count - took, room - took
    return out


def fill(sizes: list[int], left: list[int], capacity: int) -> dict[int, int]:
    """A configuration: how many pieces of each group go into one sequence so that it is as full as can be (knapsack).

    The longest group that still has pieces takes part, so that long pieces are not left for the end.
    """
    first = next(i for i, n in enumerate(left) if n)
    room = capacity - sizes[first]
    reach = np.full(room + 1, -1, dtype=np.int64)  # last group used to reach a fill, -2 for nothing
    reach[0] = -2
    back = np.zeros(room + 1, dtype=np.int64)
    for g in range(first, len(sizes)):
        spare = left[g] - (g == first)
        s = sizes[g]
        if spare <= 0 or s > room:
            continue
        for _ in range(min(spare, room // s)):
            fresh = np.flatnonzero((reach[:-s] != -1) & (reach[s:] == -1)) + s
            if not len(fresh):
                break
            reach[fresh], back[fresh] = g, fresh - s
        if reach[room] != -1:
            break
    at = int(np.flatnonzero(reach != -1)[-1])
    took = {first: 1}
    while at:
        took[int(reach[at])] = took.get(int(reach[at]), 0) + 1
        at = int(back[at])
    return took


def dearest(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The configuration of largest total value (unbounded knapsack), one more piece a round."""
    best, took = np.zeros(capacity + 1), []
    at = np.arange(capacity + 1)[None, :] - sizes[:, None]
    while True:
        more = np.where(at >= 0, best[np.maximum(at, 0)] + values[:, None], -1.0)
        pick = more.argmax(axis=0)
        new = more[pick, np.arange(capacity + 1)]
        better = new > best + 1e-12
        if not better.any():
            break
        best = np.where(better, new, best)
        took.append(np.where(better, pick, -1))
    out: dict[int, int] = {}
    room = capacity
    for picks in reversed(took):
        if (g := int(picks[room])) >= 0:
            out[g] = out.get(g, 0) + 1
            room -= int(sizes[g])
    return float(best[capacity]), out


def optimised(sizes: list[int], numbers: list[int], capacity: int, rounds: int = 4000) -> tuple[list[tuple[dict[int, int], float]], float]:
    """The least number of sequences, in fractions, that hold `numbers` pieces of `sizes`: (configuration, times), bound.

    The linear program over configurations, by column generation: a basis of as many configurations as there are
    sizes, prices of the sizes from it, and the dearest configuration at these prices enters. The bound is a least
    number of sequences for the rounded sizes; it equals the sum of the times where the program is solved.
    """
    n = np.array(numbers, dtype=np.float64)
    s = np.array(sizes)
    columns = [{i: capacity // x} for i, x in enumerate(sizes)]
    basis = np.diag([float(capacity // x) for x in sizes])
    bound = 0.0
    for _ in range(rounds):
        times = np.linalg.solve(basis, n)
        price = np.linalg.solve(basis.T, np.ones(len(s)))
        value, took = dearest(s, np.maximum(price, 0.0), capacity)
        bound = max(bound, float(np.maximum(price, 0.0) @ n) / max(value, 1.0))
        if value <= 1 + 1e-7:
            break
        column = np.zeros(len(s))
        column[list(took)] = list(took.values())
        change = np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, np.maximum(times, 0.0) / np.where(change > 1e-9, change, 1.0), np.inf)
        out = int(ratio.argmin())
        basis[:, out], columns[out] = column, took
    return [(c, t) for c, t in zip(columns, np.maximum(np.linalg.solve(basis, n), 0.0).tolist(), strict=True)], bound


def configurations(sizes: list[int], numbers: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations and how often each is used, until no piece of any group is left.

    The optimised ones first, each as often as whole pieces allow; what that leaves, less than a sequence or so a
    configuration, is filled one by one.
    """
    left, out = list(numbers), []
    for took, times in optimised(sizes, numbers, capacity)[0] if sizes else []:
        whole = min([int(times + 1e-6), *(left[g] // c for g, c in took.items())])
        if whole:
            out.append((took, whole))
            for g, c in took.items():
                left[g] -= c * whole
    while any(left):
        took = fill(sizes, left, capacity)
        times = min(left[g] // n for g, n in took.items())
        for g, n in took.items():
            left[g] -= n * times
        out.append((took, times))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: rows (length, from rank, to rank, first sequence, pieces a sequence, offset).

    The piece of rank r of a row lies in sequence first + (r - from) // a, at offset + (r - from) % a * length. Large
    lengths are grouped and rounded up; configurations of groups are chosen; each group's slots then take its actual
    pieces, longest first. Small pieces, longest first, go where they fit best; what fits nowhere opens sequences.
    """
    grouped = groups_of({n: c for n, c in counts.items() if n < capacity}, capacity // small, groups)
    chosen = configurations([g[0][0] for g in grouped], [sum(c for _, c in g) for g in grouped], capacity)
    used: dict[int, int] = {}
    out: list[tuple[int, int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # by room: runs of sequences (first, number)

    def place(length: int, first: int, times: int, each: int, offset: int) -> None:
        rank = used.get(length, 0)
        out.append((length, rank, rank + times * each, first, each, offset))
        used[length] = rank + times * each

    first = counts.get(capacity, 0)
    if first:  # full pieces are sequences of their own
        place(capacity, 0, first, 1, 0)
    queues = [list(g) for g in grouped]
    for took, times in chosen:
        while times:
            # a run of sequences whose slots all take the same lengths
            run, slots = times, []
            for g, n in took.items():
                length, number = queues[g][0]
                if number >= n:
                    slots.append((g, [(length, n)]))
                    run = min(run, number // n)
                else:  # this one sequence takes several lengths of the group
                    need, parts = n, []
                    for length_, number_ in queues[g]:
                        t = min(need, number_)
                        parts.append((length_, t))
                        need -= t
                        if not need:
                            break
                    slots.append((g, parts))
                    run = 1
            offset = 0
            for g, parts in slots:
                for length, n in parts:
                    place(length, first, run, n, offset)
                    offset += n * length
                    queues[g][0] = (length, queues[g][0][1] - n * run)
                    if not queues[g][0][1]:
                        queues[g].pop(0)
            open_.setdefault(capacity - offset, []).append((first, run))
            first, times = first + run, times - run
    for length in sorted((n for n in counts if n <= capacity // small), reverse=True):
        number = counts[length]
        while number:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                each = min(capacity // length, number)
                run = number // each
                place(length, first, run, each, 0)
                open_.setdefault(capacity - each * length, []).append((first, run))
                first, number = first + run, number - run * each
                continue
            at, run = open_[room].pop()
            if not open_[room]:
                del open_[room]
            each = min(room // length, number)
            took = min(run, number // each)
            place(length, at, took, each, capacity - room)
            number -= took * each
            open_.setdefault(room - each * length, []).append((at, took))
            if run > took:
                open_.setdefault(room, []).append((at + took, run - took))
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Packs documents into sequences of at most `capacity` tokens; a row for each piece.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only longer documents are cut. Null and empty
    texts are the END token alone; repeated rows and null ids are documents of their own; an empty table gives no
    sequence. Other columns are not read.
    """
    spark = docs.sparkSession
    pieces = tokenised(docs, path, capacity)
    by_part = stable(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "pack-counts")
    counts = {row["length"]: row["n"] for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(starts.hint("merge"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    rows = np.array(sorted(plan(counts, capacity)), dtype=np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(rows)  # grows with the lengths and configurations, not with the pieces

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        where = rows[:, 0] << 48 | rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = rows[np.searchsorted(where, (length.astype(np.int64) << 48) | rank, side="right") - 1]
            within, each = rank - row[:, 1], row[:, 4]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start")] + [pa.array(length.astype(np.int64)), batch.column("ids_crc32"), pa.array(row[:, 3] + within // each), pa.array(row[:, 5] + within % each * length)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10(docs: DataFrame) -> DataFrame:
    return pack(docs)
