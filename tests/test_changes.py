"""Renames, temporal findings and agreement of samples as multisets, on small tables."""

import collections
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from verdictlake.operators import confidence, gate, ledger
from verdictlake.plans import household, rulesets, schema


def test_renames_close_and_apply(spark):
    names = lambda pairs: spark.createDataFrame(pairs, "old STRING, new STRING")
    chain = [(f"a{i}", f"a{i + 1}") for i in range(20)]
    assert {r.old: r.new for r in ledger.close_renames(names([*chain, ("x", "y"), ("x", "z"), ("q", "q"), (None, "w"), ("w", None)])).collect()} == {**{f"a{i}": "a20" for i in range(20)}, "x": "y"}
    assert ledger.close_renames(names([])).collect() == []
    for ring in ([("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b")]):
        with pytest.raises(ValueError, match="ring"):
            ledger.close_renames(names(ring))
    profiles = spark.createDataFrame([(1, {"a": 1, "c": 3}), (2, {"b": 5, "a": 6}), (3, {}), (4, None)], "id LONG, facts MAP<STRING, INT>")
    got = {r.id: r.facts for r in ledger.renamed_facts(profiles, ["id"], "facts", names([("a", "b"), ("b", "n"), ("c", "n")])).collect()}
    assert got == {1: {"n": 1}, 2: {"n": 6}, 3: {}, 4: {}}
    kept = ledger.renamed_facts(profiles, ["id"], "facts", names([("a", "c")])).collect()
    assert {r.id: r.facts for r in kept}[1] == {"c": 3}


def test_reuse_lists_what_to_ask(spark):
    stored = spark.createDataFrame([(1, {"old": 1, "k": 2}), (2, {"old": 1}), (3, {"old": 1, "k": 2})], "id LONG, facts MAP<STRING, INT>")
    now = spark.createDataFrame([(1, {"k": 2, "new": 1}), (2, {"new": 1, "k": None}), (3, {"new": 9}), (4, {"b": 1, "a": 2})], "id LONG, facts MAP<STRING, INT>")
    got = {r.id: (r.status, r.to_ask) for r in ledger.reuse_renamed(stored, now, ["id"], "facts", spark.createDataFrame([("old", "new")], "old STRING, new STRING")).collect()}
    assert got == {1: ("reused", []), 2: ("stale", ["k"]), 3: ("stale", ["new"]), 4: ("new", ["a", "b"])}


def test_samples_as_multisets(spark):
    rows = [("s", 0, "a"), ("s", 0, "a"), ("s", 0, None), ("s", 1, "a"), ("s", 1, "b"), ("t", 0, "a"), ("u", 0, "a")]
    gold = [("s", "a"), ("s", None), ("u", "a")]
    samples, g = spark.createDataFrame(rows, "scheme_id STRING, sample INT, k STRING"), spark.createDataFrame(gold, "scheme_id STRING, k STRING")
    drafts = spark.createDataFrame([("s", 0), ("s", 1), ("s", 2), ("t", 0), ("u", 0), ("u", 1)], "scheme_id STRING, sample INT")
    valid, wanted = {"s": 3, "u": 2}, collections.Counter(gold)
    count = collections.Counter(rows)
    want = {(s, i, k, n, min(n, wanted[s, k]), len({x[1] for x in rows if x[0] == s and x[2] == k}) / valid[s]) for (s, i, k), n in count.items() if s in valid}
    assert {tuple(r) for r in confidence.multiset_agreement(samples, g, ["k"], drafts).select("scheme_id", "sample", "k", "n", "correct", "agreement").collect()} == want
    got = {r.scheme_id: (r.predicates, round(r.precision, 6)) for r in confidence.multiset_summary(confidence.multiset_agreement(samples, g, ["k"])).collect()}
    assert got == {"s": (5, 0.6)}  # two copies of a: one is right; t and u have one sample each


def test_temporal_findings(spark):
    day = lambda n: dt.date(2020, 1, n)
    history = spark.createDataFrame([("s", "v1", day(1), None, None, None, None), ("s", "v2", day(5), None, None, None, None), ("t", "only", None, None, None, None, None)], "scheme_id STRING, version STRING, valid_from DATE, valid_to DATE, supersedes_version STRING, retired_field STRING, quote STRING")
    good = "the limit of two hectares is removed"
    findings = spark.createDataFrame([("s", 1, 0.9, "temporal_supersession", "v1", "land", good, day(9)), ("s", 0, 0.9, "temporal_supersession", "v0", "age", good, None), ("s", 2, 0.1, "temporal_supersession", "v1", "x", good, None), ("s", 3, 0.9, "tone", None, None, None, None), ("t", 0, 0.9, "temporal_supersession", "only", "x", "never said anywhere", None), ("z", 0, 0.9, "temporal_supersession", "v", "x", good, None)], "scheme_id STRING, ordinal INT, confidence DOUBLE, category STRING, rule_version STRING, retired_field STRING, quote STRING, new_valid_from DATE")
    changed, log = gate.apply_temporal(history, findings)
    assert {(r.scheme_id, r.version): (r.valid_from, r.valid_to, r.supersedes_version, r.retired_field) for r in changed.collect()} == {("s", "v1"): (day(1), day(9), None, None), ("s", "v2"): (day(9), None, "v1", "land"), ("t", "only"): (None, None, "only", "x")}
    assert {(r.scheme_id, r.ordinal): r.why for r in log.collect()} == {("s", 1): "applied", ("s", 0): "applied", ("s", 2): "below threshold", ("s", 3): "nothing retired", ("t", 0): "applied", ("z", 0): "no version"}
    documents = spark.createDataFrame([("s", f"From 9 January  {good.upper()}."), ("t", "else")], "scheme_id STRING, document STRING")
    assert {r.scheme_id: r.faults for r in gate.chain_faults(changed, documents).collect()} == {"s": [], "t": ["order", "fabricated"]}
    assert {r.version for r in gate.selected_as_of(changed, F.lit(day(8))).collect()} == {"v1", "only"}
    assert {r.version for r in gate.selected_as_of(changed, F.lit(day(9))).collect()} == {"v2", "only"}


def test_closed_schema(spark):
    good = rulesets.to_dict(household.H1)
    leaf = {"field": "a", "op": "==", "value": None, "cat": "other"}
    deep = leaf
    for i in range(4):
        deep = {("and", "or")[i % 2]: [deep, leaf]}
    texts = {
        "good": json.dumps(good), "deep": json.dumps(good | {"inclusion": deep}), "null": None, "cut": json.dumps(good)[:-1], "list": "[1]", "text": '"x"',
        "full": json.dumps(good | {"temporal_validity": {"valid_from": None, "extracted_at": "2020-01-01", "supersedes": {"rule_version": "1", "retired_predicate": {"any": [1]}, "amendment_source": "s"}}, "extraction_metadata": {"confidence": 1, "source_clause": "c"}}),
        "odd": json.dumps({"scheme_id": 5, "inclusion": {"and": [leaf | {"cat": "nope"}, "x", {"or": {}}, {}]}, "exclusions": [leaf | {"except": {"field": "a"}, "count": 1.5}], "operational_requirements": ["a", 1], "temporal_validity": {"valid_to": 3}, "more": 1}),
    }
    df = spark.createDataFrame(list(texts.items()), "scheme_id STRING, rules STRING")
    valid, quarantine = schema.split_by_schema(df)
    got = {(r.scheme_id, f.path, f.fault) for r in quarantine.collect() for f in r.faults}
    odd = {("scheme_id", "wrong type"), ("more", "unknown key"), ("inclusion.and[0].cat", "unknown value"), ("inclusion.and[1]", "wrong type"), ("inclusion.and[2].or", "wrong type"), *((f"inclusion.and[3].{k}", "missing key") for k in ("field", "op", "value", "cat")), ("exclusions[0].except.op", "missing key"), ("exclusions[0].except.value", "missing key"), ("exclusions[0].count", "wrong type"), ("operational_requirements[1]", "wrong type"), ("temporal_validity.valid_to", "wrong type"), ("temporal_validity.extracted_at", "missing key")}
    assert got == {("null", "", "not JSON"), ("cut", "", "not JSON"), ("list", "", "wrong type"), ("text", "", "wrong type")} | {("odd", *x) for x in odd}
    assert {r.scheme_id for r in valid.collect()} == {"good", "deep", "full"}
    assert rulesets.flatten_json(df.where("scheme_id IN ('cut', 'deep')")).where("location = 'inclusion'").count() == 5


def test_injected_errors_are_balanced_and_leave_rules_valid(spark):
    rows = [(f"s{i}", o, loc, op, {"kind": kind, "num": 1.0, "str": None, "arr": None}, ex) for i in range(60) for o, (loc, op, kind, ex) in enumerate([("inclusion", "in", "str", False), ("inclusion", ">=", "num", False), ("exclusion", "==", "bool", True), ("exclusion", "<", "num", False)][: 2 + i % 3])]
    rows += [("lone", 0, "inclusion", "in", {"kind": "str", "num": None, "str": "x", "arr": None}, False)]
    flat = spark.createDataFrame(rows, "scheme_id STRING, ordinal INT, location STRING, op STRING, value STRUCT<kind: STRING, num: DOUBLE, str: STRING, arr: ARRAY<STRING>>, has_except BOOLEAN")
    for errors, per in ((None, 3), (100, 3), (7, 2)):
        got = gate.valid_errors(flat, errors, per).collect()
        assert len({(r.scheme_id, r.ordinal) for r in got}) == len(got) and (errors is None or len(got) == errors)
        by = collections.defaultdict(list)
        for r in got:
            by[r.scheme_id].append(r)
        room = {s: sum(1 for x in rows if x[0] == s) for s in {x[0] for x in rows}}
        most = max(map(len, by.values()))
        assert all(sorted(r.turn for r in some) == list(range(len(some))) for some in by.values())
        assert all(len(by[s]) >= min(most - 1, n - 1) for s, n in room.items() if s != "lone")  # fewest errors first, as far as there is room
        for s, some in by.items():
            for v in {r.variant for r in some}:
                mine = [r for r in some if r.variant == v]
                assert len(mine) <= per and [r.place for r in sorted(mine, key=lambda r: r.turn)] == list(range(len(mine)))
                assert sum(r.kind == "predicate_dropped" for r in mine) < sum(x[0] == s and x[2] == "inclusion" for x in rows)
    assert "lone" not in by and gate.valid_errors(flat.limit(0)).collect() == []
    assert {r.kind for r in gate.valid_errors(flat).collect()} == set(gate.ERROR_KINDS)


def test_exceptions_go_with_their_exclusions(spark):
    flat = rulesets.flat_table(spark, [household.H1])
    drawn = spark.createDataFrame([("H1", 3, "exclusion_dropped", 0, 0), ("H1", 4, "exception_dropped", 1, 0)], "scheme_id STRING, ordinal INT, kind STRING, variant INT, place INT")
    got = collections.defaultdict(set)
    for r in gate.mutate(flat, drawn).collect():
        got[r.variant].add((r.path, r.has_except))
    whole = {(r.path, r.has_except) for r in flat.collect()}
    assert got[0] == whole - {("exclusions[0]", True), ("exclusions[0].except", False)}
    assert got[1] == whole - {("exclusions[1]", True), ("exclusions[1].except", False)} | {("exclusions[1]", False)}
