"""Evaluation of very many rule sets that arrive as a table, by an index of their leaves.

Rule sets are dealt into blocks. For each field a block has its sorted thresholds and, for every place between and on
them, what all its leaves say: a fact finds its place by one search and so resolves every leaf that reads it. What rule
sets of a block have in common, leaves, nodes and exclusions, is evaluated once. Profiles travel in batches; batches and
blocks meet by block number, so no row is dealt by field and no rule passes the driver.

For tallies, rule sets that differ in one threshold at most are one class. A profile is evaluated once per class, with
that leaf true and with it false; sums in the order of its fact then tell the tally of every threshold. Where all blocks
are few bytes, tasks have them all and profiles come as columns of the facts that are read, without batches that travel.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake.functions.values import DDL
from verdictlake.operators.evaluate import ELIGIBLE, INELIGIBLE, UNDETERMINED, prepared
from verdictlake.sources.shared import frozen

#: Rule sets of a block, profiles of a batch, and blocks that a worker keeps open.
BLOCK, BATCH, KEPT = 512, 1024, 64
#: For tallies: profiles of a batch, results of leaves that a task holds at a time, thresholds of a class.
COUNTED, HELD, SWEPT = 4096, 16 << 20, 1 << 20
#: Bytes of all blocks up to which tasks have them all (they pass the driver then); beyond, batches go to them. Classes, or places of rules, up to which they are broadcast.
SENT, NAMED = 4 << 20, 20_000
#: Trits: AND is the smaller, OR the larger, NOT the difference from TRUE.
FALSE, UNKNOWN, TRUE = np.int8(0), np.int8(1), np.int8(2)
NUMBER, TEXT, NULL, LIST = range(4)
KIND = {"bool": NUMBER, "num": NUMBER, "str": TEXT, "null": NULL, "list": LIST}
NAMES = np.array([INELIGIBLE, UNDETERMINED, ELIGIBLE])
_STEP = re.compile(r"\.(and|or)\[(\d+)\]$")


class Leaves:
    """Leaves by the field they read, with a table of results for each kind of fact: a row a leaf, a column a place among the thresholds."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.n, self.fields = len(rows), {}
        for field, at in rows.reset_index(drop=True).groupby("field").indices.items():
            some = [(rows["op"].iloc[i], rows["value"].iloc[i]) for i in at]
            listed = [v["arr"] for _, v in some if v["kind"] == "list"]
            numbers = sorted({v["num"] for _, v in some if v["kind"] in ("bool", "num")} | {float(c[2:]) for a in listed for c in a if c.startswith("n:")})
            texts = sorted({v["str"] for _, v in some if v["kind"] == "str"} | {c[2:] for a in listed for c in a if c.startswith("s:")})
            tables = [np.array([self._row(op, v, kind, marks) for op, v in some], dtype=np.int8) for kind, marks in ((NUMBER, numbers), (TEXT, texts), (NULL, []), (LIST, []))]
            begins = np.cumsum([0, *(t.shape[1] for t in tables)])  # of the kinds' places; the last place is that of no fact
            inside = [(at[i], op == "in", v["str"]) for i, (op, v) in enumerate(some) if v["kind"] == "str" and op in ("in", "not_in")]
            same = [(at[i], op == "==", tuple(v["arr"])) for i, (op, v) in enumerate(some) if v["kind"] == "list" and op in ("==", "!=")]
            self.fields[field] = (at, np.array(numbers), texts, np.hstack([*tables, np.full((len(at), 1), UNKNOWN)]), begins, inside, same)

    def needs(self) -> dict[str, set[str]]:
        """By field, which parts of a value its leaves look at besides its kind."""
        return {f: {x for x, yes in (("num", len(numbers)), ("str", texts or inside), ("arr", same)) if yes} for f, (_, numbers, texts, _, _, inside, same) in self.fields.items()}

    @staticmethod
    def _row(op: str, expected: dict, kind: int, marks: list) -> np.ndarray:
        """A leaf's results at the places of a kind: 2 k + 1 is the threshold number k, even places lie between."""
        places, wanted = np.arange(2 * len(marks) + 1), KIND[expected["kind"]]
        if op in ("in", "not_in"):
            if wanted != LIST or kind == LIST:
                return np.full(len(places), UNKNOWN)
            codes = {NUMBER: {float(c[2:]) for c in expected["arr"] if c.startswith("n:")}, TEXT: {c[2:] for c in expected["arr"] if c.startswith("s:")}, NULL: set()}[kind]
            hit = np.isin(places, [2 * k + 1 for k, m in enumerate(marks) if m in codes]) | (kind == NULL and "0:" in expected["arr"])
            return np.where(hit == (op == "in"), TRUE, FALSE)
        if wanted != kind:
            return np.full(len(places), {"==": FALSE, "!=": TRUE}.get(op, UNKNOWN))
        if kind in (NULL, LIST):  # equal lists are told apart by value
            return np.full(len(places), {"==": TRUE, "!=": FALSE}.get(op, UNKNOWN) if kind == NULL else {"==": FALSE, "!=": TRUE}.get(op, UNKNOWN))
        at = 2 * bisect_left(marks, expected["num"] if kind == NUMBER else expected["str"]) + 1
        return np.where({"==": places == at, "!=": places != at, "<": places < at, "<=": places <= at, ">": places > at, ">=": places >= at}[op], TRUE, FALSE)

    def results(self, facts: dict[str, tuple], width: int) -> np.ndarray:
        """A trit for each leaf and column; facts: field to (columns, kinds, numbers, texts, lists). Absent facts are unknown."""
        out = np.full((self.n, width), UNKNOWN)
        for field, (at, numbers, texts, table, begins, inside, same) in self.fields.items():
            if field not in facts:
                continue
            columns, kinds, nums, strs, lists = facts[field]
            places = np.full(width, begins[-1])
            for kind in (NUMBER, TEXT, NULL, LIST):
                mine = np.flatnonzero(kinds == kind)
                if not len(mine):
                    continue
                place = np.zeros(len(mine), np.int64)
                if kind == NUMBER and len(numbers):
                    left = np.searchsorted(numbers, nums[mine])
                    place = 2 * left + (np.searchsorted(numbers, nums[mine], "right") > left)
                elif kind == TEXT and (texts or inside):
                    codes, different = pd.factorize(strs[mine])
                    left = [bisect_left(texts, s) for s in different]
                    place = np.array([2 * k + (k < len(texts) and texts[k] == s) for k, s in zip(left, different, strict=True)])[codes]
                places[columns[mine]] = begins[kind] + place
            out[at] = table.take(places, axis=1)
            for i, wanted, text in inside:
                mine = np.flatnonzero(kinds == TEXT)
                codes, different = pd.factorize(strs[mine])
                out[i, columns[mine]] = np.where(np.array([(s in text) == wanted for s in different], dtype=bool)[codes], TRUE, FALSE)
            for i, wanted, value in same:
                mine = np.flatnonzero(kinds == LIST)
                out[i, columns[mine]] = np.where(np.array([(tuple(x) == value) == wanted for x in lists[mine]], dtype=bool), TRUE, FALSE)
        return out


class _Numbered(dict):
    """Numbers for what is asked for, in the order in which it first is."""

    def __missing__(self, key):
        self[key] = len(self)
        return self[key]


class Index:
    """A block of rule sets: leaves of the applicant and of the family, nodes of trees, exclusions, each different one once."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.schemes = sorted(rows["scheme_id"].unique())
        own, family, nodes, held, sets = (_Numbered() for _ in range(5))
        kept: dict[str, dict] = {}

        def leaf(some: _Numbered, r) -> int:
            v = r.value
            key = (r.field, r.op, v["kind"], v["num"], v["str"], v["arr"] if v["arr"] is None else tuple(v["arr"]))
            kept.setdefault(repr(key), {"field": r.field, "op": r.op, "value": v})
            return some[repr(key)]

        found: dict[str, dict[str, dict]] = {}
        for r in rows.itertuples(index=False):
            found.setdefault(r.scheme_id, {}).setdefault(r.location, {})[r.path] = r
        roots = []
        for scheme in self.schemes:
            trees, rules, spared = (found[scheme].get(x, {}) for x in ("inclusion", "exclusion", "exception"))
            top = {p: nodes["swept", r.field, r.op] if r.value["kind"] == "swept" else nodes["leaf", leaf(own, r)] for p, r in trees.items()}
            for depth in range(max((p.count(".") for p in top), default=0), 0, -1):
                below: dict[tuple, set] = {}
                for p in [p for p in top if p.count(".") == depth]:
                    if m := _STEP.search(p):
                        below.setdefault((p[: m.start()], m[1]), set()).add(top.pop(p))
                top |= {p: nodes[kind, *sorted(parts)] for (p, kind), parts in below.items()}
            out = set()
            for p, r in rules.items():
                e, alone = spared.get(f"{p}.except"), r.quantifier == "self"
                waiver = e is not None and e.except_scope == "applicant"
                some = own if alone else family
                counted = (r.quantifier, r.count_op, 0 if pd.isna(r.count) else r.count) if r.quantifier == "count_family_members" else (r.quantifier, None, 0)
                out.add(held[alone, leaf(some, r), -1 if e is None or waiver else leaf(some, e), leaf(own, e) if waiver else -1, *counted])
            roots.append((top.get("inclusion", -1), sets[tuple(sorted(out))]))
        self.own, self.family = (Leaves(pd.DataFrame([kept[k] for k in some], columns=["field", "op", "value"])) for some in (own, family))
        self.nodes, self.held, self.sets, self.roots = (list(x) for x in (nodes, held, sets, roots))

    def tree(self, own: np.ndarray, swept: dict[tuple, np.ndarray]) -> list[np.ndarray]:
        """A row of trits for each node; the last one, unknown, serves rule sets without a root."""
        values: list[np.ndarray] = []
        for what, *parts in self.nodes:
            if what in ("leaf", "swept"):
                values.append(own[parts[0]] if what == "leaf" else swept[tuple(parts)])
            else:
                value = values[parts[0]]
                for i in parts[1:]:
                    value = (np.minimum if what == "and" else np.maximum)(value, values[i])
                values.append(value)
        return [*values, np.full(own.shape[1], UNKNOWN)]

    def counted(self, hits: np.ndarray, starts: np.ndarray, quantifier: str, op: str | None, n: int) -> np.ndarray:
        """An exclusion over the family, from the trits of its members."""
        if quantifier != "count_family_members":
            return (np.minimum if quantifier == "all_family_members" else np.maximum).reduceat(hits, starts)
        low, open_ = (np.add.reduceat(hits == x, starts, dtype=np.int64) for x in (TRUE, UNKNOWN))
        high = low + open_
        yes, no = {"<=": (high <= n, low > n), "<": (high < n, low >= n), ">=": (low >= n, high < n), ">": (low > n, high <= n)}.get(op) or ((low == n) & (high == n), (low > n) | (high < n))
        return np.where(yes, TRUE, np.where(no, FALSE, UNKNOWN))

    def excluded(self, batch: Batch, own: np.ndarray) -> list[np.ndarray]:
        """A row of trits for each different set of exclusions."""
        family, held = self.family.results(batch.family, batch.width), []
        for alone, i, spared, waiver, *counted in self.held:
            some = own if alone else family
            hits = some[i] if spared < 0 else np.minimum(some[i], TRUE - some[spared])
            result = hits if alone else self.counted(hits, batch.starts, *counted)
            held.append(result if waiver < 0 else np.minimum(result, TRUE - own[waiver]))
        return [np.maximum.reduce([held[i] for i in some]) if some else np.full(batch.n, FALSE) for some in self.sets]

    def evaluate(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Trits of inclusion and exclusion, a row for each rule set and a column for each profile."""
        own = self.own.results(batch.own, batch.n)
        tree, excluded = self.tree(own, {}), self.excluded(batch, own)
        return tuple(np.array([of[i] for i in at]) for of, at in zip((tree, excluded), zip(*self.roots, strict=True), strict=True))


class Classes(Index):
    """A block of classes of rule sets that differ in one threshold, of an inclusion leaf; scheme_id is the class."""

    def __init__(self, rows: pd.DataFrame) -> None:
        super().__init__(rows)
        swept = rows[(rows["location"] == "inclusion") & rows["value"].map(lambda v: v["kind"] == "swept")]
        by = {r.scheme_id: (r.field, r.op) for r in swept.itertuples(index=False)}
        self.swept = [by.get(s) for s in self.schemes]
        listed = rows[rows["thresholds"].notna()]
        found = dict(zip(listed["scheme_id"], listed["thresholds"], strict=True))
        self.thresholds = [np.sort(np.asarray(found[s], dtype=float)) for s in self.schemes]
        #: By field the different thresholds, and for each class the places of its own among them.
        mine = lambda field: [t for t, x in zip(self.thresholds, self.swept, strict=True) if x and x[0] == field]
        self.marks = {field: np.unique(np.concatenate(mine(field))) for field, _ in set(by.values())}
        self.places = [x and np.searchsorted(self.marks[x[0]], t) for t, x in zip(self.thresholds, self.swept, strict=True)]

    def needs(self) -> tuple[dict[str, set[str]], dict[str, set[str]]]:
        own, family = self.own.needs(), self.family.needs()
        for field in self.marks:
            own.setdefault(field, set()).add("num")
        return own, family

    def sides(self, batch: Batch) -> tuple[list, list, list, dict[str, np.ndarray]]:
        """Rows of the tree with the swept leaves true, and with them false, of exclusion, and the facts that swept leaves read, NaN where there is no number.

        A fact that is no number gives its own result on both sides.
        """
        own = self.own.results(batch.own, batch.n)
        facts, numbers, others = {}, {}, {}
        for field in self.marks:
            facts[field], numbers[field], others[field] = np.full(batch.n, np.nan), np.zeros(batch.n, bool), np.zeros(batch.n, bool)
            if field in batch.own:
                columns, kinds, nums = batch.own[field][:3]
                facts[field][columns[kinds == NUMBER]] = nums[kinds == NUMBER]
                numbers[field][columns[kinds == NUMBER]] = True
                others[field][columns[kinds > NUMBER]] = True
        either = ({x: np.where(numbers[x[0]], side, np.where(others[x[0]], {"==": FALSE, "!=": TRUE}.get(x[1], UNKNOWN), UNKNOWN)) for x in set(self.swept) - {None}} for side in (TRUE, FALSE))
        return *(self.tree(own, swept) for swept in either), self.excluded(batch, own), facts


#: By verdicts with the swept leaf true and with it false, 3 yes + no: what its being true adds to the eligible, and 65,536 times what it adds to the ineligible.
_ADDS = np.array([(yes == 2) - (no == 2) + 65536 * ((yes == 0) - (no == 0)) for yes in range(3) for no in range(3)], dtype=np.int32)


class Tally:
    """How many profiles get each verdict, for each class and threshold of a block."""

    def __init__(self, index: Classes) -> None:
        self.index, self.n = index, 0
        self.base = {v: np.zeros(len(index.schemes), np.int64) for v in (TRUE, FALSE)}
        self.more = {v: [np.zeros(len(t), np.int64) for t in index.thresholds] for v in (TRUE, FALSE)}

    def slices(self, rows: int, width: int) -> Iterator[tuple[int, int]]:
        """Begin and length of the parts of so many profiles with so many members that are evaluated at a time."""
        results = 1 + self.index.own.n * rows + self.index.family.n * width
        step = max(1, min(COUNTED, rows * HELD // results))
        yield from ((at, min(step, rows - at)) for at in range(0, rows, step))

    def add(self, batch: Batch) -> None:
        """Adds what the swept leaf being true changes: the sum over the facts for which a threshold makes it so."""
        index = self.index
        with_, without, excluded, facts = index.sides(batch)
        self.n += batch.n
        orders = {field: np.argsort(x, kind="stable") for field, x in facts.items()}
        ends = {field: [np.searchsorted(facts[field][orders[field]], marks, side) for side in ("left", "right")] for field, marks in index.marks.items()}
        free = [TRUE - x for x in excluded]
        sums = np.zeros(batch.n + 1, np.int32)
        for k, (root, out) in enumerate(index.roots):
            no = np.minimum(without[root], free[out])
            for v in self.base:
                self.base[v][k] += np.count_nonzero(no == v)
            if index.swept[k]:
                field, op = index.swept[k]
                low, high = (x[index.places[k]] for x in ends[field])
                np.cumsum(_ADDS[(3 * np.minimum(with_[root], free[out]) + no)[orders[field]]], out=sums[1:])
                found = {"<": lambda: sums[low], "<=": lambda: sums[high], ">": lambda: sums[-1] - sums[high], ">=": lambda: sums[-1] - sums[low], "==": lambda: sums[high] - sums[low], "!=": lambda: sums[-1] - sums[high] + sums[low]}[op]()  # noqa: B023
                less = (found + 32768) >> 16
                self.more[TRUE][k] += found - (less << 16)
                self.more[FALSE][k] += less

    def rows(self) -> pa.RecordBatch:
        sizes = [len(t) for t in self.index.thresholds]
        yes, no = (np.repeat(self.base[v], sizes) + np.concatenate(self.more[v]) for v in (TRUE, FALSE))
        names = pa.array(np.repeat(np.array(self.index.schemes, dtype=object), sizes), pa.string())
        return pa.RecordBatch.from_arrays([names, pa.array(np.concatenate(self.index.thresholds)), *map(pa.array, (yes, no, self.n - yes - no))], ["class", "threshold", "eligible", "ineligible", "undetermined"])


class Batch:
    """Profiles as columns: the applicant's facts by profile, and the household's by member, the applicant first."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        members, self.ids, self.n = rows.column("members"), rows.column("profile_id"), rows.num_rows
        flat = members.values
        sizes = np.nan_to_num(np.array(members.value_lengths().to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
        of = np.repeat(np.arange(self.n), sizes)
        ix = flat.field("ix").fill_null(-1 << 31).to_numpy(zero_copy_only=False)
        applicant = np.zeros(len(ix), dtype=bool)
        applicant[np.flatnonzero(ix == 0)[np.unique(of[ix == 0], return_index=True)[1]]] = True
        other = (ix != 0) & (ix != -1 << 31)
        count = np.bincount(of[other], minlength=self.n)
        self.starts = np.concatenate(([0], np.cumsum(count + 1)[:-1]))
        self.width = int((count + 1).sum())
        column = np.full(len(ix), -1)
        column[applicant] = self.starts[of[applicant]]
        column[other] = self.starts[of[other]] + 1 + np.arange(other.sum()) - np.repeat(np.cumsum(count) - count, count)
        maps = flat.field("facts")
        member = np.repeat(np.arange(len(ix)), np.diff(maps.offsets.to_numpy()))
        value = maps.items
        kinds = pd.Series(value.field("kind").to_pandas()).map(KIND).fillna(-1).to_numpy(dtype=np.int64)
        nums = value.field("num").to_numpy(zero_copy_only=False)
        strs, lists = (value.field(x).to_pandas().to_numpy(dtype=object) for x in ("str", "arr"))
        codes, names = pd.factorize(maps.keys.to_pandas())
        self.own, self.family = {}, {}
        for i, name in enumerate(names):
            at = np.flatnonzero((codes == i) & (column[member] >= 0))
            self.family[name] = (column[member[at]], kinds[at], nums[at], strs[at], lists[at])
            at = at[applicant[member[at]]]
            self.own[name] = (of[member[at]], kinds[at], nums[at], strs[at], lists[at])


class Facts(Batch):
    """Profiles of _facts(): a column for each part of a fact of the applicant, and of the household, the applicant first."""

    def __init__(self, rows: pa.RecordBatch, own: dict[str, set[str]], family: dict[str, set[str]]) -> None:
        self.n = rows.num_rows
        self.own = self._read(rows.column, own, "o")
        self.starts, self.width, self.family = np.arange(self.n), self.n, {}
        if family:
            members = rows.column("family")
            sizes = members.value_lengths().to_numpy()
            flat = members.flatten()
            self.starts, self.width = np.concatenate(([0], np.cumsum(sizes)[:-1])), len(flat)
            self.family = self._read(flat.field, family, "f")

    @staticmethod
    def _read(column, needs: dict[str, set[str]], side: str) -> dict[str, tuple]:
        found = {}
        for i, (field, parts) in enumerate(sorted(needs.items())):
            kinds = column(f"{side}{i}_kind")
            at = np.flatnonzero(kinds.is_valid().to_numpy(zero_copy_only=False))
            get = lambda x, i=i, at=at, parts=parts: column(f"{side}{i}_{x}").take(pa.array(at)).to_pandas().to_numpy() if x in parts else None
            nums = column(f"{side}{i}_num").to_numpy(zero_copy_only=False)[at] if "num" in parts else None
            found[field] = (at, kinds.fill_null(-1).to_numpy(zero_copy_only=False)[at], nums, get("str"), get("arr"))
        return found


def _facts(profiles: DataFrame, own: dict[str, set[str]], family: dict[str, set[str]]) -> DataFrame:
    """The parts of the facts that are read, as columns of the applicant and of an array of members."""

    def parts(facts: Column, needs: dict[str, set[str]], side: str) -> list[Column]:
        out = []
        for i, (field, some) in enumerate(sorted(needs.items())):
            value = facts[field]
            code = F.when(value["kind"].isin("bool", "num"), NUMBER).when(value["kind"] == "str", TEXT).when(value["kind"] == "null", NULL).when(value["kind"] == "list", LIST).otherwise(-1)
            out += [F.when(F.map_contains_key(facts, field), code).cast("tinyint").alias(f"{side}{i}_kind"), *(value[x].alias(f"{side}{i}_{x}") for x in sorted(some))]
        return out

    household = [F.transform("_fam", lambda m: F.struct(*parts(m["facts"], family, "f"))).alias("family")] if family else []
    return prepared(profiles).select(F.lit(0).cast("tinyint").alias("_"), *parts(F.col("_me"), own, "o"), *household)


def _built(kind: type[Index]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "index": [pickle.dumps(kind(rows))]})

    return run


def _nested(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, batch.schema) as stream:
                    stream.write_batch(batch.slice(at, size))
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["profiles"])

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, pa.Scalar]]:
    """Each batch of profiles with its blocks, one after another."""
    last, some = None, None
    for batch in batches:
        for profiles, block, data in zip(batch.column("profiles"), batch.column("block").to_pylist(), batch.column("index"), strict=True):
            if last is None or profiles != last:
                last, some = profiles, pa.ipc.open_stream(profiles.as_py()).read_all().combine_chunks().to_batches()[0]
            yield some, block, data


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    indexes: dict[int, Index] = {}
    for rows, block, data in _meetings(batches):
        some = Batch(rows)
        if block not in indexes:
            if len(indexes) >= KEPT:
                indexes.pop(next(iter(indexes)))
            indexes[block] = pickle.loads(data.as_py())
        index = indexes[block]
        included, excluded = index.evaluate(some)
        verdict = np.minimum(included, TRUE - excluded)
        for i, scheme in enumerate(index.schemes):
            yield pa.RecordBatch.from_arrays([some.ids, pa.array([scheme] * some.n), pa.array(NAMES[verdict[i]]), *(pa.array(x[i] == TRUE, mask=x[i] == UNKNOWN) for x in (included, excluded))], ["profile_id", "scheme_id", "verdict", "included", "excluded"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tallies: dict[int, Tally] = {}
    for some, block, data in _meetings(batches):
        if block not in tallies:
            if len(tallies) >= KEPT:
                yield tallies.pop(next(iter(tallies))).rows()
            tallies[block] = Tally(pickle.loads(data.as_py()))
        for at, n in tallies[block].slices(some.num_rows, len(some.column("members").flatten()) + some.num_rows):
            tallies[block].add(Batch(some.slice(at, n)))
    for t in tallies.values():
        yield t.rows()


def _counted_by(blocks: list[bytes], own: dict[str, set[str]], family: dict[str, set[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = [Tally(pickle.loads(data)) for data in blocks]
        for rows in batches:
            for t in tallies:
                for at, n in t.slices(rows.num_rows, len(rows.column("family").flatten()) if family else 0):
                    t.add(Facts(rows.slice(at, n), own, family))
        for t in tallies:
            if t.n:
                yield t.rows()

    return run


_RULE = ["path", "location", "field", "op", "value", "quantifier", "except_scope", "count_op", "count"]


def _blocks(rules: DataFrame, kind: type[Index]) -> tuple[DataFrame, list[bytes] | None]:
    """block, index; and the indexes themselves if all are few bytes."""
    blocks = rules.groupBy("block").applyInPandas(_built(kind), "block int, index binary")
    if (blocks.agg(F.sum(F.length("index"))).first()[0] or 0) > SENT:
        return blocks, None
    return blocks, [bytes(x["index"]) for x in blocks.collect()]


def _together(profiles: DataFrame, blocks: DataFrame, few: bool, n: int, size: int, run, schema: str) -> DataFrame:
    """Batches of so many profiles, met by all n blocks."""
    batches = profiles.select("profile_id", F.col("members").cast(f"array<struct<ix: int, facts: map<string, {DDL}>>>").alias("members")).mapInArrow(_nested(size), "profiles binary")
    met = batches.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(F.broadcast(blocks) if few else blocks, "block")
    return met.select("profiles", "block", "index").mapInArrow(run, schema)


def classes(flat: DataFrame) -> DataFrame:
    """scheme_id, class, threshold, swept of each rule set; one class's rules are equal but for the threshold, of the leaf at the path swept.

    Left out is the number that an inclusion leaf is compared with, of the leaf whose place has most different numbers
    in the table. A rule set without such a leaf has the threshold 0 and all its rules. Sets of rules are compared by sums
    of two hashes of 64 bits of each rule, so that a rule travels as a few numbers.
    """
    v = F.col("value")
    number = (F.col("location") == "inclusion") & v["kind"].isin("bool", "num") & v["num"].isNotNull() & ~F.isnan(v["num"]) & F.col("op").isin("<", "<=", ">", ">=", "==", "!=")
    places = frozen(flat.where(number).groupBy("path", "field", "op").agg(F.approx_count_distinct(v["num"]).alias("different")).withColumn("location", F.lit("inclusion")))
    places = F.broadcast(places) if places.count() <= NAMED else places  # else rules would be dealt by their place
    said = [F.col(c) for c in _RULE if c != "value"] + [v["kind"], v["str"], F.transform(v["arr"], lambda x: F.coalesce(x, F.lit("0")))]
    said = [x for c in said for x in (c, c.isNull())]  # a hash leaves nulls out
    rules = flat.join(places, ["path", "field", "op", "location"], "left").withColumns({f"b{i}": F.xxhash64(F.lit(i), *said) for i in (1, 2)})
    rules = rules.select("scheme_id", "path", v["num"].alias("num"), F.when(number, F.col("different")).alias("different"), "b1", "b2", *[F.xxhash64(f"b{i}", v["num"], v["num"].isNull()).alias(f"h{i}") for i in (1, 2)])
    halves = lambda x: (F.shiftrightunsigned(x, 32), F.col(x).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    sums = [F.sum(half).alias(f"s{i}{k}") for i in (1, 2) for k, half in enumerate(halves(f"h{i}"))]
    whole = rules.groupBy("scheme_id").agg(F.count("*").alias("n"), *sums, F.max(F.when(F.col("different").isNotNull(), F.struct("different", "path", "num", "b1", "b2", "h1", "h2"))).alias("x"))
    whole = whole.select("scheme_id", "n", *[f"s{i}{k}" for i in (1, 2) for k in (0, 1)], "x.*")
    kept = [F.col(f"s{i}{k}") - F.coalesce(half, F.lit(0)) for i in (1, 2) for k, half in enumerate(halves(f"h{i}"))]
    return whole.select("scheme_id", F.md5(F.concat_ws(":", "n", *kept, F.coalesce("b1", F.lit(0)), F.coalesce("b2", F.lit(0)), F.col("path").isNull().cast("string"))).alias("class"), F.coalesce("num", F.lit(0.0)).alias("threshold"), F.col("path").alias("swept"))


def verdicts(profiles: DataFrame, flat: DataFrame) -> DataFrame:
    """profile_id, scheme_id, verdict, included, excluded for every profile and every rule set of the flat table.

    A value that can't be compared counts as unknown, as in relational.verdicts(). An applicant without record has no
    facts. A rule set without inclusion leaves is undecided at best.
    """
    kind = profiles.schema["profile_id"].dataType.simpleString()
    schemes = flat.agg(F.approx_count_distinct("scheme_id")).first()[0]  # any number of blocks is right
    n = max(1, -(-schemes // BLOCK))
    rules = flat.select(F.pmod(F.xxhash64("scheme_id"), F.lit(n)).cast("int").alias("block"), "scheme_id", *_RULE[:-1], F.col("count").cast("double").alias("count"))
    blocks, few = _blocks(rules, Index)
    return _together(profiles, blocks, few is not None, n, BATCH, _met, f"profile_id {kind}, scheme_id string, verdict string, included boolean, excluded boolean")


def tallies(profiles: DataFrame, flat: DataFrame) -> DataFrame:
    """scheme_id, eligible, ineligible, undetermined: how many profiles get each verdict.

    Work grows with profiles times classes() of rule sets; tasks give a row for each class and threshold, so there are
    a few for each core. Rules of a class are those of one of its rule sets.
    """
    sorts = frozen(classes(flat))
    number, variants = sorts.agg(F.approx_count_distinct("class"), F.approx_count_distinct(F.xxhash64("class", "threshold"))).first()
    parts = max(1, -(-variants // SWEPT))  # of a class's thresholds; any number is right, as of blocks
    n = max(1, -(-number * parts // BLOCK))
    one = sorts.select("class", "threshold").distinct().withColumn("part", F.pmod(F.xxhash64("threshold"), F.lit(parts))).groupBy("class", "part").agg(F.collect_list("threshold").alias("thresholds"))
    named = sorts.groupBy("class").agg(F.min(F.struct("scheme_id", "swept")).alias("s")).select("class", F.col("s.scheme_id").alias("_one"), "s.swept")
    left_out = F.expr(f"CAST(named_struct('kind', 'swept', 'num', NULL, 'str', NULL, 'arr', NULL) AS {DDL})")
    rules = flat.join(F.broadcast(named) if number <= NAMED else named, F.col("scheme_id").eqNullSafe(F.col("_one")))
    rules = rules.withColumn("value", F.when((F.col("location") == "inclusion") & (F.col("path") == F.col("swept")), left_out).otherwise(F.col("value").cast(DDL)))
    rules = rules.groupBy("class").agg(F.collect_list(F.struct(*_RULE[:-1], F.col("count").cast("double").alias("count"))).alias("rules")).join(one, "class")
    rules = rules.select(F.pmod(F.xxhash64("class", "part"), F.lit(n)).cast("int").alias("block"), F.concat_ws("-", "class", "part").alias("scheme_id"), "thresholds", F.posexplode("rules").alias("i", "r"))
    rules = rules.select("block", "scheme_id", "r.*", F.when(F.col("i") == 0, F.col("thresholds")).alias("thresholds"))
    sums, schema = ("eligible", "ineligible", "undetermined"), "class string, threshold double, eligible long, ineligible long, undetermined long"
    blocks, few = _blocks(rules, Classes)
    if few is None:
        counts = _together(profiles, blocks, False, n, COUNTED, _counted, schema)
    else:
        own, family = {}, {}
        for data in few:
            for found, needs in zip((own, family), pickle.loads(data).needs(), strict=True):
                for field, some in needs.items():
                    found[field] = found.get(field, set()) | some
        counts = _facts(profiles, own, family).coalesce(4 * profiles.sparkSession.sparkContext.defaultParallelism).mapInArrow(_counted_by(few, own, family), schema)
    found = counts.groupBy(F.substring_index("class", "-", 1).alias("class"), "threshold").agg(*[F.sum(c).alias(c) for c in sums])
    return sorts.select("scheme_id", "class", "threshold").join(found, ["class", "threshold"]).select("scheme_id", *sums)
