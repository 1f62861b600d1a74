"""Conversation repair: the cheapest edits that give a conversation legal roles, by a stream over sorted turns."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What the edits cost, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: White space, and what ends a sentence.
BLANKS, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: States: nothing yet, after a system turn, after a user's, after an assistant's. The role that each state asks for next.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
CLOSED = ((START, 0), (SYSTEM, 2), (USER, 1), (ASSISTANT, 0))
SUFFIXES = ("D", "IIK", "IIR", "IK", "IR", "K", "R")
#: Bytes of a conversation that stay in memory; what is longer goes to the task's scratch file.
IN_MEMORY = 8 << 20
BLOCK = 1 << 16

REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SCHEMA = f"conv_id STRING, place BIGINT, edit STRING, role STRING, text STRING, {', '.join(f'{c} BIGINT' for c in REPORT)}, audit STRING, repaired_sha256 STRING"


@cache
def _moves(kind: str) -> tuple[tuple[int, int, int, int], ...]:
    """(from, to, cost, place in SUFFIXES) of the ways to deal with a turn: kind is its role's initial, a t for truncated, or x for one that has to go.

    At most two turns are inserted before it; more would come back to the same state. None is inserted before a
    deletion: after it costs the same and reads less.
    """
    found = [(q, q, DELETE, 0) for q in range(4)]
    if kind != "x":
        more = TRUNCATED if kind.endswith("t") else 0
        for q in range(4):
            at = q
            for inserted in range(3):
                head = "I" * inserted
                found.append((q, NEXT[at], INSERT * inserted + REROLE + more, SUFFIXES.index(f"{head}R")))
                wanted = {USER: "u", ASSISTANT: "a"}[NEXT[at]]
                if kind[:1] == wanted:
                    found.append((q, NEXT[at], INSERT * inserted + more, SUFFIXES.index(f"{head}K")))
                elif kind[:1] == "s" and at == START:
                    found.append((q, SYSTEM, more, SUFFIXES.index("K")))
                at = NEXT[at]
    return tuple(found)


@cache
def _step(costs: tuple, ranks: tuple, kind: str) -> tuple[tuple, tuple, int, bytes]:
    """The next costs (from 0) and ranks of the four states, what was taken off the costs, and a way back for each state.

    The rank orders the edits that lead to the states, as strings: strings with as many turns dealt with that end in
    one never begin one another, so the order of two stays whatever follows. None is the cost of a state out of reach.
    """
    best: list = [None] * 4
    for q, to, cost, suffix in _moves(kind):
        if costs[q] is not None:
            way = (costs[q] + cost, ranks[q], suffix, q)
            if best[to] is None or way < best[to]:
                best[to] = way
    least = min(b[0] for b in best if b)
    order = sorted((b[1:3], to) for to, b in enumerate(best) if b)
    ranked = [0] * 4
    for rank, (_, to) in enumerate(order):
        ranked[to] = rank
    return tuple(b and b[0] - least for b in best), tuple(ranked), least, bytes(b[3] * 8 + b[2] if b else 0 for b in best)


class _Conversation:
    """The state that is carried over a conversation's turns in order; ways back and turns are spilled when large."""

    def __init__(self) -> None:
        self.costs, self.ranks, self.cost = (0, None, None, None), (0, 0, 0, 0), 0
        self.ways, self.turns = (tempfile.SpooledTemporaryFile(IN_MEMORY) for _ in range(2))
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.last = self.before = None
        self.distinct = self.n = 0

    def add(self, turn: str | None, role: str, text: str, seen: bool) -> None:
        body, initial = text.rstrip(BLANKS), role[:1]
        fault = "blank" if not body else "duplicate" if seen else "" if body.endswith(ENDS) else "truncated"
        if fault:
            self.counts[fault] += 1
        if self.n and self.before + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        if turn is not None and turn != self.last:
            self.low, self.last, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        self.before, self.n = initial, self.n + 1
        kind = "x" if fault in ("blank", "duplicate") else (initial if initial in ("s", "u", "a") else "-") + ("t" if fault else "")
        self.costs, self.ranks, off, ways = _step(self.costs, self.ranks, kind)
        self.cost += off
        self.ways.write(ways)
        pickle.dump((role, text), self.turns)

    def _back(self, state: int) -> bytes:
        """The suffixes from the first turn to the last, read off the ways back from the end, a block at a time."""
        out, at = bytearray(), self.n
        while at:
            size = min(BLOCK, at)
            at -= size
            self.ways.seek(4 * at)
            block = self.ways.read(4 * size)
            for i in range(size - 1, -1, -1):
                way = block[4 * i + state]
                out.append(way & 7)
                state = way >> 3
        out.reverse()
        return bytes(out)

    def finish(self) -> Iterator[tuple]:
        """Rows (place, edit, role, text) of the edits, then the report, a dict."""
        _, _, tail, state = min((self.costs[q] + INSERT * more, self.ranks[q], more, q) for q, more in CLOSED if self.costs[q] is not None)
        self.cost += self.costs[state] + INSERT * tail
        suffixes, digest, audit, at, place, first = self._back(state), hashlib.sha256(), [], START, 0, True
        self.turns.seek(0)
        for code in [*suffixes, None] if tail else suffixes:
            role, text = pickle.load(self.turns) if code is not None else (None, None)
            letters = "I" * tail if code is None else SUFFIXES[code]
            audit.append(letters)
            for edit in letters:
                to = at if edit == "D" else SYSTEM if edit == "K" and role[:1] == "s" else NEXT[at]
                said = {"D": (role, text), "K": (role, text), "R": (ROLE.get(to), text), "I": (ROLE.get(to), "")}[edit]
                if edit != "D":
                    digest.update(("" if first else "\n").encode() + f"{said[0]}:{said[1]}".encode())
                    first = False
                yield place, edit, *said
                at, place = to, place + 1
        gaps = int(self.last) - int(self.low) + 1 - self.distinct if self.last is not None else 0
        self.ways.close()
        self.turns.close()
        yield self.counts | {"gaps": gaps, "cost": self.cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}


def _frames(rows: Iterator[list], size: int = 4096) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    block: list = []
    for row in rows:
        block.append(row)
        if len(block) == size:
            yield pd.DataFrame(block, columns=columns, dtype=object)
            block = []
    if block:
        yield pd.DataFrame(block, columns=columns, dtype=object)


def _streamed(edits: bool):
    """Turns sorted by conversation and turn, in batches, to edits and reports; what a conversation carries crosses batches."""

    def rows(key: str | None, conversation: _Conversation) -> Iterator[list]:
        for x in conversation.finish():
            if isinstance(x, dict):
                yield [key, None, None, None, None, *(x[c] for c in REPORT), x["audit"], x["repaired_sha256"]]
            elif edits:
                yield [key, *x, *[None] * (len(REPORT) + 2)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def all_rows() -> Iterator[list]:
            key, open_ = None, None
            for batch in batches:
                for conv, turn, role, text, seen in zip(*(batch[c].tolist() for c in ("conv_id", "turn", "role", "text", "seen")), strict=True):
                    if open_ is None or conv != key:
                        if open_ is not None:
                            yield from rows(key, open_)
                        key, open_ = conv, _Conversation()
                    open_.add(turn, role, text, seen)
            if open_ is not None:
                yield from rows(key, open_)

        yield from _frames(all_rows())

    return run


def repair(turns: DataFrame, edits: bool = True) -> DataFrame:
    """Edits of conversations (conv_id, turn, role, text) that make their roles an optional system turn and then pairs of user and assistant.

    The cheapest edits are taken, of equal ones those whose initials read least: Keep 0, Rerole 3, Delete 4, Insert 3
    of an empty turn anywhere; blank turns and ones whose role and text came before are deleted, a truncated one that
    stays adds 3. A conversation may end up empty. Returns, for each conversation, a row with `audit` and the report
    columns (place is null there) and, with `edits`, a row for each edit: place, edit (K, R, D, I), and the role and
    text that result (of a deletion: those deleted).

    Turns are hashed by conversation and sorted by turn (nulls first; equal turns by role and text), and one stream
    reads them: its state is four costs, an order and counts. Ways back (4 bytes a turn) and the turns wait in a
    scratch file of the task past IN_MEMORY bytes, so a conversation of any size needs a bounded memory besides its
    audit. A conversation is read by one task, as its turns have an order. Null roles and texts count as one space;
    turns with null conv_id are one conversation. Repeated rows are duplicates; other columns are not read. An empty
    table gives no rows.
    """
    rows = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    rows = rows.withColumn("seen", again).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "seen")
    out = rows.select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "seen").mapInPandas(_streamed(edits), SCHEMA)
    return out.withColumn("conv_id", F.col("conv_id").cast(turns.schema["conv_id"].dataType))


def repaired(edits: DataFrame) -> DataFrame:
    """The turns of repair()'s rows: conv_id, place, role, text."""
    return edits.where("edit IN ('K', 'R', 'I')").select("conv_id", "place", "role", "text")


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults dealt by a checksum of conv_id:turn (nulls: one space): gone, emptied, without sentence ends, repeated, or said by the user."""
    gap = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(gap("conv_id"), F.lit(":"), gap("turn")).cast("binary")) % 20
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace(gap("text"), "[.!?]", "")).otherwise(gap("text"))
    rows = turns.select("conv_id", "turn", F.when(way == 4, "user").otherwise(gap("role")).alias("role"), text.alias("text"), way.alias("_way")).where("_way <> 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_way") == 3, 2).otherwise(1)))).drop("_way", "_copy")


def op13(turns: DataFrame) -> DataFrame:
    """The report on every conversation of the table, damaged first; one whose rows are all gone has zeros and nothing to repair."""
    found = repair(damage(turns), edits=False)
    every = turns.select(F.col("conv_id").alias("_id")).distinct()
    both = every.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    none = hashlib.sha256().hexdigest()
    return both.select(F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in REPORT], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
