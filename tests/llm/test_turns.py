"""Conversation repair against plain versions: all edits of short conversations, strings carried whole for longer ones."""

import collections
import hashlib
import itertools
import random
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from verdictlake.llm import turns

TURNS = "conv_id LONG, turn LONG, role STRING, text STRING"
WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    """blank, duplicate, truncated or None for each (role, text)."""
    out, seen = [], set()
    for role, text in rows:
        body = text.strip(WHITE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def apply(rows, audit):
    """Cost and the resulting turns of an audit string, or None if it does not fit."""
    cost, out, left, wrong = 0, [], list(zip(rows, faults(rows), strict=True)), None
    turn = lambda: "assistant" if out and out[-1][0][:1] == "u" else "user"
    for letter in audit:
        if letter == "I":
            cost, out = cost + 3, [*out, (turn(), "")]
            continue
        if not left:
            return None
        (role, text), wrong = left.pop(0)
        if letter == "D":
            cost += 4
            continue
        if wrong in ("blank", "duplicate"):
            return None
        cost += 3 * (wrong == "truncated") + 3 * (letter == "R")
        out.append((turn() if letter == "R" else role, text))
    return None if left or not re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) else (cost, audit, out)


def all_edits(rows):
    heads = ["", "I", "II", "III"]
    best = None
    for parts in itertools.product(itertools.product(heads, "DKR"), repeat=len(rows)):
        for tail in heads:
            done = apply(rows, "".join(a + b for a, b in parts) + tail)
            if done and (best is None or done[:2] < best[:2]):
                best = done
    return best


def plain(rows):
    """The same by the best string to the end from each turn and state."""
    wrong, memo = faults(rows), {}

    def go(i, state):
        key = i, state
        if key not in memo:
            memo[key] = (9**9, "")  # more than two inserted turns in a row lead nowhere new
            found = [(0, "")] if i == len(rows) and state in "0a" else []
            new = "a" if state == "u" else "u"
            for inserted, at in ((1, new), (2, "a" if new == "u" else "u")):
                if i == len(rows):
                    found += [(3 * inserted, "I" * inserted)] if at == "a" else []
            if i < len(rows):
                c, s = go(i + 1, state)
                found.append((4 + c, "D" + s))
                if wrong[i] not in ("blank", "duplicate"):
                    more = 3 * (wrong[i] == "truncated")
                    for head, at in (("", state), ("I", new), ("II", "a" if new == "u" else "u")):
                        to = "a" if at == "u" else "u"
                        c, s = go(i + 1, to)
                        found.append((3 * len(head) + 3 + more + c, f"{head}R{s}"))
                        first = rows[i][0][:1]
                        if first == to or (first == "s" and at == "0"):
                            c, s = go(i + 1, first)
                            found.append((3 * len(head) + more + c, f"{head}K{s}"))
            memo[key] = min(found, default=(9**9, ""))
        return memo[key]

    return apply(rows, go(0, "0")[1])


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return out


def report(rows, given):
    """The contract's columns by conv_id, for rows after damage and all ids given."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        by[conv].append((turn, role, text))
    out = {}
    for conv in given:
        mine = by[conv]
        said = [(r, t) for _, r, t in mine]
        n, turns_ = collections.Counter(faults(said)), {t for t, _, _ in mine if t is not None}
        cost, audit, fixed = plain(said)
        gaps = max(turns_) - min(turns_) + 1 - len(turns_) if turns_ else 0
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest)
    return out


def test_plain_version_tries_all_edits():
    rng = random.Random(5)
    for _ in range(40):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "no", "", "Why?"])) for _ in range(rng.randrange(4))]
        assert plain(rows) == all_edits(rows), rows


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_op13_equals_plain(spark, scale):
    df = spark.read.parquet(f"{DATA.replace('sf0.001', scale)}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in turns.op13(df).collect()}
    assert got == report(damaged(rows), {r[0] for r in rows})


def test_op13_on_odd_rows(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(-3, 12)]), rng.choice([None, "", "user", "assistant", "system", "agent", "Tool"]), rng.choice([None, "", " \n", "Yes.", "no", "Why? ", "ü!", " ", "a:b\nc."])) for _ in range(900)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{TURNS}, seen STRING, audit INT")
    got = {r.conv_id: tuple(r)[1:] for r in turns.op13(df).collect()}
    assert got == report(damaged(rows), {r[0] for r in rows})
    assert turns.op13(df.limit(0)).collect() == []


def test_conversation_whose_rows_are_all_gone(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = turns.op13(spark.createDataFrame([(gone, 0, "user", "Hi.")], TURNS)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_spilled_state_gives_the_same(monkeypatch):
    rng, found = random.Random(9), []
    rows = [(str(i), rng.choice(["user", "assistant"]), rng.choice(["a.", "b", f"{i}!"]), False) for i in range(5_000)]
    for limit, block in ((8 << 20, 1 << 16), (64, 7)):
        monkeypatch.setattr(turns, "IN_MEMORY", limit)
        monkeypatch.setattr(turns, "BLOCK", block)
        carried = turns._Conversation()
        for row in rows:
            carried.add(*row)
        assert carried.ways._rolled == (limit == 64)
        found.append(list(carried.finish()))
    assert found[0] == found[1]


def test_a_giant_conversation_crosses_batches(spark):
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{i}!", f"{i}", ""])) for i in range(30_000)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, TURNS)
    out = turns.repair(df).persist()
    edits = out.where("edit IS NOT NULL AND conv_id = 1").orderBy("place").collect()
    said = [(r[2], r[3]) for r in rows if r[0] == 1]
    audit = "".join(e.edit for e in edits)
    assert [e.place for e in edits] == list(range(len(edits)))
    cost, _, fixed = apply(said, audit)
    assert fixed == [(e.role, e.text) for e in edits if e.edit != "D"] == [(r.role, r.text) for r in turns.repaired(out).where("conv_id = 1").orderBy("place").collect()]
    found = {r.conv_id: r for r in out.where("audit IS NOT NULL").collect()}
    assert (found[1].cost, found[1].audit, found[2].audit) == (cost, audit, "KK")
    first = [i for i, _ in enumerate(said) if i < 600]
    short = turns.repair(df.where(F.col("turn").isin(first) & (F.col("conv_id") == 1)), edits=False).first()
    sys.setrecursionlimit(10_000)
    assert (short.cost, short.audit) == plain(said[:600])[:2]
