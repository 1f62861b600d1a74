"""Which missing fact to ask next, and whether it can still change a verdict."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdictlake.operators import plain
from verdictlake.operators.evaluate import leaf_result, prepared
from verdictlake.operators.plain import holds
from verdictlake.plans.rulesets import Exclusion, Leaf, RuleSet, leaves


#: Kinds of households whose chats a task remembers.
KINDS = 200_000


def region_values(rules: RuleSet, field: str) -> list:
    """Values of a field, one for each region that its rules tell apart."""
    every = [leaf for _, leaf in leaves(rules.inclusion)] + [x for x in rules.exclusions] + [x.exception for x in rules.exclusions if x.exception]
    values = [leaf.value for leaf in every if leaf.field == field]
    flat = [v for value in values for v in (value if isinstance(value, list | tuple) else [value])]
    if any(isinstance(v, bool) for v in flat):
        return [True, False]
    if flat and all(isinstance(v, int | float) for v in flat):
        t = sorted({float(v) for v in flat})
        return sorted({*t, t[0] - 1, t[-1] + 1, *((a + b) / 2 for a, b in itertools.pairwise(t))})
    return [*dict.fromkeys(map(str, flat)), "<none of these>"]


def read_fields(rules: RuleSet) -> tuple[list[str], list[str]]:
    """Fields that the rules read of the applicant, and of every member of the household."""
    own = [leaf.field for _, leaf in leaves(rules.inclusion)] + [x.exception.field for x in rules.exclusions if x.exception and x.except_scope == "applicant"]
    inner = lambda x: [x.field] + ([x.exception.field] if x.exception and x.except_scope == "member" else [])
    family = [f for x in rules.exclusions if x.quantifier != "self" for f in inner(x)]
    own += [f for x in rules.exclusions if x.quantifier == "self" for f in inner(x)] + family
    return list(dict.fromkeys(own)), list(dict.fromkeys(family))


class Reach:
    """Whether one of the applicant's facts can change the verdict, from what a profile's leaves say and which facts it lacks.

    Every result is a vector of trits (0 false, 1 unknown, 2 true), one for each region of the asked fact's values; a
    node has the set of vectors that the open facts can still give it. An open fact that one leaf reads gives that leaf
    either result whatever the others are, so sets of different leaves combine freely. Facts of the applicant that more
    leaves read are fixed first, to each of their regions in turn. Facts of other members are read by exclusions over
    the family alone: members are folded one after another into joint states of these exclusions (whether some hold,
    whether all do, how many), so what grows with the members is a count and not the product of their regions.
    """

    def __init__(self, rules: RuleSet, field: str) -> None:
        self.rules, self.field = rules, field
        self.many = [x for x in rules.exclusions if x.quantifier != "self"]
        inner = lambda x: [x] + ([x.exception] if x.exception and x.except_scope == "member" else [])
        self.family = [leaf for x in self.many for leaf in inner(x)]
        self.own = [leaf for _, leaf in leaves(rules.inclusion)] + [leaf for x in rules.exclusions for leaf in [x, *([x.exception] if x.exception else [])]]
        self.own_fields, self.family_fields = (list(dict.fromkeys(leaf.field for leaf in some)) for some in (self.own, self.family))
        self.regions = {f: region_values(rules, f) for f in self.own_fields}
        self.found: dict[str, bool] = {}

    def options(self, some: list, field: str) -> list[dict[int, int]]:
        """For each region of a field that its leaves tell apart, the trits of those of `some` that read it."""
        at = [i for i, leaf in enumerate(some) if leaf.field == field]
        return [dict(zip(at, t, strict=True)) for t in dict.fromkeys(tuple(holds(some[i].op, v, some[i].value) for i in at) for v in self.regions[field])]

    def __call__(self, said: str) -> bool:
        if said not in self.found:
            me, others = said.split("|", 1)
            self.found[said] = self._changes(me, Counter(filter(None, others.split("/"))))
        return self.found[said]

    def _changes(self, me: str, others: Counter) -> bool:
        trits, lacks = ["FUT".index(c) for c in me[: len(self.own)]], {f for f, c in zip(self.own_fields, me[len(self.own) :], strict=True) if c == "o"}
        if self.field not in lacks:
            return False
        asked = self.options(self.own, self.field)
        if len(asked) < 2:
            return False
        readers = {f: [i for i, leaf in enumerate(self.own) if leaf.field == f] for f in lacks - {self.field}}
        free = {at[0]: {t[at[0]] for t in self.options(self.own, f)} for f, at in readers.items() if len(at) == 1}
        shared = [self.options(self.own, f) for f, at in readers.items() if len(at) > 1]
        members = self._members(others)
        for fixed in itertools.product(*shared):
            now = dict(enumerate(trits)) | {i: t for part in fixed for i, t in part.items()}
            sets = [{tuple(part[i] for part in asked)} if i in asked[0] else {(t,) * len(asked) for t in free.get(i, (now[i],))} for i in range(len(self.own))]
            if self._differs(sets, members, len(asked)):
                return True
        return False

    def _members(self, others: Counter) -> list[tuple[set[tuple[int, ...]], int]]:
        """For each kind of member the trits that the exclusions over the family can get from one, and how many there are."""
        out = []
        for said, n in others.items():
            known, lacks = ["FUT".index(c) for c in said[: len(self.family)]], [f for f, c in zip(self.family_fields, said[len(self.family) :], strict=True) if c == "o"]
            results = set()
            for fill in itertools.product(*(self.options(self.family, f) for f in lacks)):
                now, hits, at = dict(enumerate(known)) | {i: t for part in fill for i, t in part.items()}, [], 0
                for x in self.many:
                    spared = x.exception is not None and x.except_scope == "member"
                    hits.append(min(now[at], 2 - now[at + 1]) if spared else now[at])
                    at += 1 + spared
                results.add(tuple(hits))
            out.append((results, n))
        return out

    def _differs(self, sets: list[set], members: list, width: int) -> bool:
        at = iter(sets)

        def tree(node: Any) -> set:
            if isinstance(node, Leaf):
                return next(at)
            parts = [tree(c) for c in node.children]
            return reduce(_pairwise(min if node.kind == "and" else max), parts, {((2,) if node.kind == "and" else (0,)) * width})

        included, single, hits, waivers = tree(self.rules.inclusion), {(0,) * width}, [], []
        for x in self.rules.exclusions:
            hit, waiver = next(at), None
            if x.exception:
                spared = {tuple(2 - t for t in v) for v in next(at)}
                hit, waiver = (_pairwise(min)(hit, spared), None) if x.except_scope == "member" else (hit, spared)
            if x.quantifier == "self":
                single = _pairwise(max)(single, _pairwise(min)(hit, waiver) if waiver else hit)
            else:
                hits.append(hit)
                waivers.append(waiver)
        excluded = single
        if self.many:
            states = {tuple(self._start(x, v) for x, v in zip(self.many, some, strict=True)) for some in itertools.product(*hits)}
            for results, n in members:
                for _ in range(n):
                    wider = {tuple(self._step(x, s, t) for x, s, t in zip(self.many, state, hit, strict=True)) for state in states for hit in results}
                    if wider == states:
                        break
                    states = wider
            ends = set()
            for state in states:
                held = [{self._end(x, s)} for x, s in zip(self.many, state, strict=True)]
                ends |= reduce(_pairwise(max), (_pairwise(min)(h, w) if w else h for h, w in zip(held, waivers, strict=True)))
            excluded = _pairwise(max)(single, ends)
        verdicts = _pairwise(min)(included, {tuple(2 - t for t in v) for v in excluded})
        return any(len(set(v)) > 1 for v in verdicts)

    @staticmethod
    def _start(x: Exclusion, hit: tuple) -> tuple:
        return tuple((int(t == 2), int(t == 1)) for t in hit) if x.quantifier == "count_family_members" else hit

    @staticmethod
    def _step(x: Exclusion, state: tuple, t: int) -> tuple:
        if x.quantifier == "count_family_members":
            return tuple((min(yes + (t == 2), x.count + 1), min(open_ + (t == 1), x.count + 1)) for yes, open_ in state)
        return tuple((min if x.quantifier == "all_family_members" else max)(s, t) for s in state)

    @staticmethod
    def _end(x: Exclusion, state: tuple) -> tuple:
        if x.quantifier != "count_family_members":
            return state
        compare = {"<": int.__lt__, "<=": int.__le__, "==": int.__eq__, ">=": int.__ge__, ">": int.__gt__}[x.count_op]
        return tuple(2 * all_ if (all_ := all(found)) or not any(found) else 1 for found in ([compare(n, x.count) for n in range(yes, yes + open_ + 1)] for yes, open_ in state))


def _pairwise(join: Callable) -> Callable[[set, set], set]:
    """The vectors that any one of the first set and any one of the second give."""
    return lambda a, b: {tuple(map(join, x, y)) for x in a for y in b}


def _reduced(facts: Column, some: list, fields: list[str]) -> Column:
    """What leaves say of a person's facts, and which of the fields are there, as a text."""
    trit = lambda r: F.when(r, "T").when(~r, "F").otherwise("U")
    return F.concat(*[trit(leaf_result(leaf, facts)) for leaf in some], *[F.when(F.map_contains_key(facts, f), ".").otherwise("o") for f in fields]) if some else F.lit("")


def could_change(profiles: DataFrame, rules: RuleSet, field: str) -> DataFrame:
    """profile_id, relevant: whether two answers for the applicant's field give different verdicts under some
    completion of the other facts that the profile lacks, the applicant's and the family's.

    Exact for any number of open facts, see Reach. Spark reduces a profile to the results of its leaves and the facts
    it lacks, members in order; what these say is worked out once for each different reduced profile of a task. A
    known field never is relevant; a value that can't be compared counts as unknown; an applicant without record has
    no facts.
    """
    reach = Reach(rules, field)

    said = _reduced
    df = prepared(profiles)
    others = F.transform(F.slice("_fam", F.lit(2), F.size("_fam")), lambda m: said(m["facts"], reach.family, reach.family_fields))
    reduced = df.select("profile_id", F.concat(said(F.col("_me"), reach.own, reach.own_fields), F.lit("|"), F.array_join(F.array_sort(others), "/")).alias("said"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).dictionary_encode()
            relevant = pa.array([reach(s) for s in texts.dictionary.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), relevant.take(texts.indices)], ["profile_id", "relevant"])

    return reduced.mapInArrow(run, f"profile_id {profiles.schema['profile_id'].dataType.simpleString()}, relevant boolean")


def chat(rules: RuleSet, full: plain.People, known: tuple[str, ...], reaches: dict[str, Reach] | None) -> tuple[str, list[str]]:
    """The verdict that a simulated chat ends with, and the facts that it asks for, as member:field.

    Of the applicant the fields in `known` are known at the start. The first missing fact is asked, with `reaches` the
    first that can change the verdict if there is one; facts of others than the applicant count as such. What the full
    profile lacks is declined: it stays unknown and is not asked again. The chat ends when the verdict is decided or
    nothing is left to ask.
    """
    people: plain.People = [{f: v for f, v in full[0].items() if f in known}, *({} for _ in full[1:])]
    asked: list[tuple[int, str]] = []
    while left := [x for x in plain.missing(rules, people) if x not in asked]:
        said = None
        pick = left[0]
        for i, field in left if reaches else ():
            said = said or _said(reaches[field], people) if i == 0 else said
            if i > 0 or reaches[field](said):
                pick = (i, field)
                break
        asked.append(pick)
        i, field = pick
        if field in full[i]:
            people[i][field] = full[i][field]
    return plain.verdict(rules, people), [f"{i}:{f}" for i, f in asked]


def _said(reach: Reach, people: plain.People) -> str:
    """What could_change() reduces a profile to; the same for every field of a rule set."""
    one = lambda facts, some, fields: "".join("FUT"[plain.leaf(leaf, facts)] for leaf in some) + "".join("." if f in facts else "o" for f in fields)
    return f"{one(people[0], reach.own, reach.own_fields)}|{'/'.join(sorted(one(m, reach.family, reach.family_fields) for m in people[1:]))}"


def simulated_chats(profiles: DataFrame, rules: RuleSet, known: tuple[str, ...] = (), relevance: bool = True) -> DataFrame:
    """profile_id, verdict, asked: chats with every profile's household, each answered from its full facts; see chat().

    A chat depends on its household alone, so all run in one scan without rounds or an exchange. It sees of a person
    only which facts are there and what the leaves say of them: Spark reduces households to a text of that, no value
    leaves it, and a task has a chat with each kind of household only.
    """
    return _chats(profiles, rules, known, (relevance,)).drop("relevance")


def compared_chats(profiles: DataFrame, rules: RuleSet, known: tuple[str, ...] = ()) -> DataFrame:
    """profile_id, relevance, verdict, asked: simulated_chats() without relevance and with it, from one scan."""
    return _chats(profiles, rules, known, (False, True))


def _chats(profiles: DataFrame, rules: RuleSet, known: tuple[str, ...], ways: tuple[bool, ...]) -> DataFrame:
    sees = Reach(rules, "")  # which leaves and fields are read of the applicant, and which of the others
    own = dict.fromkeys(leaf.field for _, leaf in leaves(rules.inclusion)) | dict.fromkeys(leaf.field for x in rules.exclusions for leaf in (x, x.exception) if leaf)
    reaches = {f: Reach(rules, f) for f in own} if any(ways) else None
    kind = profiles.schema["profile_id"].dataType.simpleString()

    def person(said: str, some: list, fields: list[str]) -> dict[str, plain.Said]:
        trits = list(zip(some, map("FUT".index, said[: len(some)]), strict=True))
        return {f: plain.Said({plain.said_of(leaf): t for leaf, t in trits if leaf.field == f}) for f, c in zip(fields, said[len(some) :], strict=True) if c == "."}

    def chats(said: str) -> list[tuple[str, list[str]]]:
        me, others = said.split("|")
        people = [person(me, sees.own, sees.own_fields), *(person(m, sees.family, sees.family_fields) for m in others.split("/") if m)]
        return [chat(rules, people, known, reaches if on else None) for on in ways]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ended: dict[str, list[tuple[str, list[str]]]] = {}
        for batch in batches:
            kinds = batch.column(1).dictionary_encode()
            texts = kinds.dictionary.to_pylist()
            if len(ended) > KINDS:
                ended.clear()
            ended |= {said: chats(said) for said in texts if said not in ended}
            for k, on in enumerate(ways):
                verdicts, asked = pa.array([ended[said][k][0] for said in texts], pa.string()), pa.array([ended[said][k][1] for said in texts], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.repeat(on, batch.num_rows), verdicts.take(kinds.indices), asked.take(kinds.indices)], ["profile_id", "relevance", "verdict", "asked"])

    parts = [_reduced(F.col("_me"), sees.own, sees.own_fields), F.lit("|")]
    if sees.family:  # else a chat doesn't see the others
        parts.append(F.array_join(F.transform(F.slice("_fam", F.lit(2), F.size("_fam")), lambda m: _reduced(m["facts"], sees.family, sees.family_fields)), "/"))
    return prepared(profiles).select("profile_id", F.concat(*parts).alias("said")).mapInArrow(run, f"profile_id {kind}, relevance boolean, verdict string, asked array<string>")


def next_fact(missing: DataFrame, fields: DataFrame) -> DataFrame:
    """The fact to ask each profile: relevant ones first, sensitive ones last, else in order of evaluation.

    missing (profile_id, ordinal, member, field, relevant), fields (field, sensitive, screened_by). A sensitive fact
    with a screening fact gives that one.
    """
    joined = missing.join(fields, "field", "left")
    order = Window.partitionBy("profile_id").orderBy(F.desc_nulls_last("relevant"), F.coalesce("sensitive", F.lit(False)), "ordinal", "member")
    first = joined.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return first.select("profile_id", "member", F.coalesce("screened_by", "field").alias("ask"), "field")


def settle_screened(facts: DataFrame, fields: DataFrame) -> DataFrame:
    """Facts with False for every sensitive fact whose screening fact is False and that is absent."""
    false = F.struct(F.lit("bool").alias("kind"), F.lit(0.0).alias("num"), F.lit(None).cast("string").alias("str"), F.lit(None).cast("array<string>").alias("arr"))
    no = facts.where("value.kind = 'bool' AND value.num = 0").select("profile_id", "member_ix", F.col("field").alias("screened_by"))
    screened, keys = fields.where("screened_by IS NOT NULL").select("field", "screened_by"), ["profile_id", "member_ix", "field"]
    new = no.join(screened, "screened_by").select(*keys, F.lit(False).alias("_there"))
    there = facts.join(screened.select("field").distinct(), "field", "left_semi").dropna(subset=keys).select(*keys, F.lit(True).alias("_there"))
    # dealt by key before they are grouped: a scan's task would else hold all its keys at once
    new = new.unionByName(there).repartition(*keys).groupBy(*keys).agg(F.max("_there").alias("_there")).where(~F.col("_there")).select(*keys)
    return facts.unionByName(new.withColumn("value", false))
