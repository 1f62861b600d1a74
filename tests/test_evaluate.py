"""Truth tables, golden cases, and random rule sets against a two-valued evaluator."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from verdictlake.functions import kleene, values
from verdictlake.operators import evaluate as E
from verdictlake.operators import indexed, questions, relational
from verdictlake.plans.rulesets import Exclusion, Leaf, Node, RuleSet, flat_table, from_dict, leaves, to_dict

MEMBERS = f"ARRAY<STRUCT<ix: INT, facts: MAP<STRING, {values.DDL}>>>"


def profiles(spark, *people):
    """Each a list of fact dicts, the applicant first; None for no applicant."""
    rows = [(i, [(j, {k: values.tagged(v) for k, v in m.items()}) for j, m in enumerate(p) if m is not None]) for i, p in enumerate(people)]
    return spark.createDataFrame(rows, f"profile_id LONG, members {MEMBERS}")


def verdicts(spark, rules, *people):
    rows = E.evaluate(profiles(spark, *people), [rules]).orderBy("profile_id").collect()
    return [r["verdict"] if r["error"] is None else "error" for r in rows]


YES = Leaf("ok", "==", True)


def test_truth_tables(spark):
    trits = [True, False, None]
    rows = spark.createDataFrame([(a, b) for a, b in itertools.product(trits, trits)], "a BOOLEAN, b BOOLEAN")
    got = rows.select("a", "b", kleene.both(F.col("a"), F.col("b")).alias("x"), kleene.either(F.col("a"), F.col("b")).alias("y"), kleene.all_of(F.array("a", "b")).alias("p"), kleene.any_of(F.array("a", "b")).alias("q")).collect()
    for r in got:
        both = False if False in (r.a, r.b) else None if None in (r.a, r.b) else True
        either = True if True in (r.a, r.b) else None if None in (r.a, r.b) else False
        assert (r.x, r.y, r.p, r.q) == (both, either, both, either)
    none = spark.range(1).select(kleene.all_of(F.lit(None).cast("array<boolean>")), kleene.any_of(F.array().cast("array<boolean>")), kleene.both(), kleene.either()).first()
    assert tuple(none) == (True, False, True, False)


def test_golden_cases(spark):
    tax = Exclusion("taxed", "==", True, quantifier="some_family_member")
    assert verdicts(spark, RuleSet("s", YES, (tax,)), [{"ok": True, "taxed": False}, {"taxed": True}], [{"ok": True, "taxed": False}, {}], [{"taxed": True}], [{"ok": False}], [{"ok": True, "taxed": False}], []) == ["ineligible", "undetermined_missing_facts", "ineligible", "ineligible", "eligible", "undetermined_missing_facts"]
    spared = Exclusion("works", "==", True, quantifier="some_family_member", exception=Leaf("group_d", "==", True))
    assert verdicts(spark, RuleSet("s", YES, (spared,)), [{"ok": True, "works": False}, {"works": True, "group_d": True}]) == ["eligible"]
    every = Exclusion("rich", "==", True, quantifier="all_family_members")
    assert verdicts(spark, RuleSet("s", YES, (every,)), [{"ok": True}, {"rich": False}, {}]) == ["eligible"]
    cap = Exclusion("claims", "==", True, quantifier="count_family_members", count_op=">=", count=2)
    assert verdicts(spark, RuleSet("s", YES, (cap,)), [{"ok": True, "claims": True}, {"claims": True}], [{"ok": True, "claims": True}, {"claims": False}], [{"ok": True, "claims": True}, {}]) == ["ineligible", "eligible", "undetermined_missing_facts"]
    waived = Exclusion("claims", "==", True, quantifier="count_family_members", count_op="<", count=2, exception=Leaf("old", "==", True), except_scope="applicant")
    assert verdicts(spark, RuleSet("s", YES, (waived,)), [{"ok": True, "claims": False, "old": True}], [{"ok": True, "claims": False, "old": False}]) == ["eligible", "ineligible"]
    wrong = Exclusion("x", "==", True, exception=Leaf("n", ">=", 3))
    assert verdicts(spark, RuleSet("s", YES, (wrong,)), [{"ok": True, "x": False, "n": "three"}]) == ["error"]


@pytest.mark.parametrize(("op", "actual", "expected", "result"), [("==", True, 1, True), ("==", "1", 1, False), ("!=", None, 3, True), ("==", None, True, False), ("<", True, 2, True), ("<", "a", "b", True), ("in", 1, [True, 2], True), ("in", "a", ["a"], True), ("not_in", "b", ["a"], True), ("in", "el", "hello", True), (">=", 2.5, 2, True), ("==", ["a"], ["a"], True)])
def test_compare(spark, op, actual, expected, result):
    assert verdicts(spark, RuleSet("s", Leaf("f", op, expected)), [{"f": actual}]) == ["eligible" if result else "ineligible"]


@pytest.mark.parametrize(("op", "actual", "expected"), [("<", "a", 1), ("<", None, 1), (">=", 1, "a"), ("in", 1, "abc"), ("in", "a", 5), ("<", 1, ["a"])])
def test_errors_are_rows(spark, op, actual, expected):
    assert verdicts(spark, RuleSet("s", Leaf("f", op, expected)), [{"f": actual}]) == ["error"]


def random_rules(r, n):
    def leaf():
        return Leaf(r.choice("abc"), r.choice(["==", "!=", "<", "<=", ">", ">="]), r.randint(0, 2))

    def tree(depth):
        return leaf() if depth == 0 or r.random() < 0.4 else Node(r.choice(["and", "or"]), tuple(tree(depth - 1) for _ in range(r.randint(1, 3))))

    def exclusion():
        q = r.choice(["self", "some_family_member", "all_family_members", "count_family_members"])
        x, scope = leaf(), r.choice(["member", "applicant"]) if q != "self" else "member"
        e = leaf() if r.random() < 0.5 else None
        return Exclusion(x.field, x.op, x.value, quantifier=q, count_op=r.choice(["<", "<=", "==", ">", ">="]) if q.startswith("count") else None, count=r.randint(0, 2) if q.startswith("count") else None, exception=e, except_scope=scope if e else "member")

    return RuleSet(f"s{n}", tree(2), tuple(exclusion() for _ in range(r.randint(0, 2))))


def plainly(rules, people):
    """The verdict where every fact is known."""
    ops = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    holds = lambda leaf, m: ops[leaf.op](m[leaf.field], leaf.value)

    def tree(node):
        if isinstance(node, Leaf):
            return holds(node, people[0])
        return all(map(tree, node.children)) if node.kind == "and" else any(map(tree, node.children))

    def excluded(x):
        who = people[:1] if x.quantifier == "self" else people
        hits = [holds(x, m) and not (x.exception and x.except_scope == "member" and holds(x.exception, m)) for m in who]
        out = all(hits) if x.quantifier.startswith("all") else ops[x.count_op](sum(hits), x.count) if x.quantifier.startswith("count") else any(hits)
        return out and not (x.exception and x.except_scope == "applicant" and holds(x.exception, people[0]))

    return "ineligible" if any(map(excluded, rules.exclusions)) or not tree(rules.inclusion) else "eligible"


def test_random_rules_are_sound(spark):
    """Complete profiles get the plain verdict; a definite verdict of a partial profile holds for its completion."""
    r = random.Random(7)
    rules = [random_rules(r, n) for n in range(12)]
    whole = [[{f: r.randint(0, 2) for f in "abc"} for _ in range(r.randint(1, 3))] for _ in range(40)]
    part = [[{f: v for f, v in m.items() if r.random() < 0.6} for m in p] for p in whole]
    rows = E.evaluate(profiles(spark, *whole, *part), rules).collect()
    got = {(x["profile_id"], x["scheme_id"]): x["verdict"] for x in rows}
    for rule in rules:
        for i, people in enumerate(whole):
            true = plainly(rule, people)
            assert got[i, rule.scheme_id] == true
            assert got[len(whole) + i, rule.scheme_id] in (true, "undetermined_missing_facts")


def test_relational_counts_match(spark):
    rules = RuleSet("s", YES, (Exclusion("t", "==", True, quantifier="some_family_member", exception=Leaf("g", "==", True)), Exclusion("q", ">=", 5, quantifier="count_family_members", count_op=">=", count=2)))
    people = [[{"t": True, "g": False, "q": 7}, {"t": False, "q": 1}, {"q": 9}], [{"t": True}, {"t": True, "g": True}]]
    p = profiles(spark, *people)
    rows = {(r.profile_id, r.path): (r["true"], r["false"], r["unknown"]) for r in relational.exclusion_counts(p, relational.facts_of(p), flat_table(spark, [rules])).collect()}
    assert rows == {(0, "exclusions[0]"): (1, 1, 1), (0, "exclusions[1]"): (2, 1, 0), (1, "exclusions[0]"): (0, 1, 1)}


def test_rule_sets_round_trip():
    r = random.Random(3)
    for n in range(50):
        rules = random_rules(r, n)
        assert from_dict(to_dict(rules)) == rules


def test_relevance_against_all_completions(spark):
    rules = RuleSet("s", Node("and", (Leaf("a", ">=", 10), Node("or", (Leaf("b", "==", True), Leaf("a", ">=", 20))))))
    p = profiles(spark, [{}], [{"a": 5}], [{"a": 25}], [{"a": 15}])
    rows = {r.profile_id: r.relevant for r in questions.could_change(p, rules, "b").collect()}
    assert rows == {0: True, 1: False, 2: False, 3: True}


def test_relevance_in_households(spark):
    count = RuleSet("s", Leaf("z", "==", True), (Exclusion("q", ">=", 5, quantifier="count_family_members", count_op=">=", count=3),))
    p = profiles(spark, [{"z": True}, {}, {}, {}], [{"z": True}, {}], [{"z": False}, {}, {}, {}], [{"z": True, "q": 1}, {}, {}, {}])
    rows = {r.profile_id: r.relevant for r in questions.could_change(p, count, "q").collect()}
    # two relatives over the limit make the applicant's answer decide; one relative can't; an unmet inclusion decides alone; what is known is not asked
    assert rows == {0: True, 1: False, 2: False, 3: False}


def test_relational_verdicts_equal_compiled_ones(spark):
    r = random.Random(8)
    rule_sets = [random_rules(r, n) for n in range(12)]
    people = [[{f: r.choice(v) for f, v in (("a", [1, 5, 9]), ("b", [True, False]), ("c", ["x", "y"])) if r.random() < 0.6} for _ in range(r.randint(1, 4))] for _ in range(25)]
    p = profiles(spark, *people)
    compiled = {(x.profile_id, x.scheme_id): x.verdict for x in E.evaluate(p, rule_sets).where("error IS NULL").collect()}
    folded = {(x.profile_id, x.scheme_id): x.verdict for x in relational.verdicts(p, flat_table(spark, rule_sets)).collect()}
    assert len(folded) == 25 * len(rule_sets) and all(folded[k] == v for k, v in compiled.items())


def test_indexed_verdicts_equal_compiled_and_relational_ones(spark, monkeypatch):
    r = random.Random(11)
    rule_sets = [random_rules(r, n) for n in range(40)]
    values_of = {"a": [1, 5, 9, 9.5, None], "b": [True, False, 1, "x"], "c": ["x", "y", "", ["x"], "yx"]}
    people = [[{f: r.choice(v) for f, v in values_of.items() if r.random() < 0.6} for _ in range(r.randint(0, 4))] for _ in range(60)] + [[None, {"a": 1, "b": True, "c": "x"}]]
    p = profiles(spark, *people)
    flat = flat_table(spark, rule_sets)
    monkeypatch.setattr(indexed, "BLOCK", 9)
    compiled = {(x.profile_id, x.scheme_id): (x.verdict, x.included, x.excluded) for x in E.evaluate(p, rule_sets).where("error IS NULL").collect()}
    found = {(x.profile_id, x.scheme_id): (x.verdict, x.included, x.excluded) for x in indexed.verdicts(p, flat).collect()}
    assert len(found) == len(people) * len(rule_sets) and len(compiled) > len(found) / 3
    assert all(found[k] == v for k, v in compiled.items())
    folded = {(x.profile_id, x.scheme_id): x.verdict for x in relational.verdicts(p.where("profile_id < 60"), flat).collect()}
    assert all(found[k][0] == v for k, v in folded.items())
    counts = {x.scheme_id: (x.eligible, x.ineligible, x.undetermined) for x in indexed.tallies(p, flat).collect()}
    assert counts == {s.scheme_id: tuple(sum(v[0] == name for k, v in found.items() if k[1] == s.scheme_id) for name in (E.ELIGIBLE, E.INELIGIBLE, E.UNDETERMINED)) for s in rule_sets}
    assert indexed.verdicts(p.limit(0), flat).collect() == [] and indexed.verdicts(p, flat.limit(0)).collect() == []


@pytest.mark.parametrize("op", ["==", "!=", "<", "<=", ">", ">=", "in", "not_in"])
def test_indexed_comparisons(spark, op):
    wanted = [True, 0, 2, 2.5, "b", "abc", "", None, [1, "b"], ["b", None], []]
    actual = [True, False, 2, 2.25, 1e6, -1, "b", "a", "", "z", None, [1, "b"], []]
    rule_sets = [RuleSet(f"s{i}", Leaf("f", op, w)) for i, w in enumerate(wanted)]
    p = profiles(spark, *[[{"f": a}] for a in actual])
    flat = flat_table(spark, rule_sets)
    found = {(x.profile_id, x.scheme_id): x.included for x in indexed.verdicts(p, flat).collect()}
    leaf = relational.leaf_results(relational.facts_of(p), flat)
    assert found == {(x.profile_id, x.scheme_id): x.result for x in leaf.collect()}


def brute_relevance(rules, people, field):
    """Whether two answers differ under some completion of all other open facts, by trying all of them on one profile."""
    asked = [x for x in rules.exclusions if x.quantifier != "self"]
    family = {leaf.field for x in asked for leaf in [x, *([x.exception] if x.exception and x.except_scope == "member" else [])]}
    every = [leaf for _, leaf in leaves(rules.inclusion)] + [leaf for x in rules.exclusions for leaf in (x, x.exception) if leaf]
    own = {leaf.field for leaf in every}
    if field in people[0] or field not in own:
        return False
    open_ = [(i, f) for i, m in enumerate(people) for f in sorted(own if i == 0 else family) if f not in m and (i, f) != (0, field)]
    ranges = {f: questions.region_values(rules, f) for f in own}
    for fill in itertools.product(*(ranges[f] for _, f in open_)):
        filled = [dict(m) for m in people]
        for (i, f), v in zip(open_, fill, strict=True):
            filled[i][f] = v
        if len({plainly(rules, [filled[0] | {field: v}, *filled[1:]]) for v in ranges[field]}) > 1:
            return True
    return False


def test_relevance_equals_brute_force(spark):
    r, cases = random.Random(21), 0
    for n in range(30):
        rules = random_rules(r, n)
        people = [[{f: r.randint(0, 2) for f in "abc" if r.random() < 0.4} for _ in range(r.randint(1, 3))] for _ in range(6)]
        p = profiles(spark, *people)
        for field in "abc":
            reach = questions.Reach(rules, field)
            if field in reach.own_fields and cases < 25:
                cases += 1
                got = {x.profile_id: x.relevant for x in questions.could_change(p, rules, field).collect()}
                assert got == {i: brute_relevance(rules, m, field) for i, m in enumerate(people)}, (rules, field)


def test_relevance_with_very_many_completions(spark):
    """Ten relatives who lack two facts each: 6^10 completions and the applicant's."""
    rules = RuleSet("s", Leaf("z", "==", True), (Exclusion("q", ">=", 5, quantifier="count_family_members", count_op=">=", count=9, exception=Leaf("w", "==", True)), Exclusion("q", ">=", 8, quantifier="all_family_members")))
    full, none = {"q": 6, "w": False}, {"q": 1, "w": True}
    p = profiles(spark, [{"z": True}, *[{}] * 10], [{"z": True, "w": False}, *[full] * 8, {}], [{"z": True, "w": False}, *[full] * 7, none], [{"z": True, "w": True}, *[full] * 8, none], [{"z": False}, *[{}] * 10], [{"z": True}, *[{}] * 300])
    got = {x.profile_id: x.relevant for x in questions.could_change(p, rules, "q").collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: True}
    assert [brute_relevance(rules, m, "q") for m in ([{"z": True, "w": False}, *[full] * 8, {}], [{"z": True, "w": False}, *[full] * 7, none])] == [True, False]
    small = RuleSet("t", Leaf("z", "==", True), (Exclusion("q", ">=", 5, quantifier="count_family_members", count_op=">=", count=3),))
    many = [[{"z": True}, *[{}] * 9], [{"z": True}, *[{"q": 1}] * 8, {}]]  # 3^9 completions; more than any cut
    got = {x.profile_id: x.relevant for x in questions.could_change(profiles(spark, *many), small, "q").collect()}
    assert got == {i: brute_relevance(small, m, "q") for i, m in enumerate(many)}


def test_chats_ask_as_the_columns_do(spark):
    """Round by round through evaluate() and missing_facts(), against one scan."""
    r = random.Random(31)
    for n in range(6):
        rules = random_rules(r, n)
        full = [[{f: r.randint(0, 2) for f in "abc" if r.random() < 0.8} for _ in range(r.randint(1, 3))] for _ in range(8)]
        chats = {x.profile_id: (x.verdict, x.asked) for x in questions.simulated_chats(profiles(spark, *full), rules, ("a",), relevance=False).collect()}
        partial = [[{k: v for k, v in m.items() if i == 0 and k == "a"} for i, m in enumerate(p)] for p in full]
        asked = [[] for _ in full]
        while True:
            todo = {}
            for x in sorted(E.missing_facts(profiles(spark, *partial), rules).collect(), key=lambda x: (x.ordinal, x.member)):
                if (x.member, x.field) not in asked[x.profile_id]:
                    todo.setdefault(x.profile_id, (x.member, x.field))
            if not todo:
                break
            for i, (m, f) in todo.items():
                asked[i].append((m, f))
                partial[i][m] |= {f: full[i][m][f]} if f in full[i][m] else {}
        ends = {x.profile_id: x.verdict for x in E.evaluate(profiles(spark, *partial), [rules]).collect()}
        assert chats == {i: (ends[i], [f"{m}:{f}" for m, f in asked[i]]) for i in range(len(full))}
        fewer = {x.profile_id: x for x in questions.simulated_chats(profiles(spark, *full), rules, ("a",)).collect()}
        assert all(fewer[i].verdict == chats[i][0] or E.UNDETERMINED in (fewer[i].verdict, chats[i][0]) for i in fewer)


def test_nested_traces_are_json_of_any_depth(spark):
    deep = Leaf("a", ">=", 3)
    for i in range(8):
        deep = Node(("and", "or")[i % 2], (deep, Leaf("q\"b", "in", ["x", "ü"])))
    rules = RuleSet("s", deep, (Exclusion("n", ">", 1, quantifier="count_family_members", count_op=">=", count=2, exception=Leaf("old", "==", True), except_scope="applicant"), Exclusion("v", "==", "w", exception=Leaf("z", "==", None))), requirements=("photo", 'a "quoted" one'))
    people = [[{"a": 5, "q\"b": 'say "hi"', "n": 2, "z": None, "v": "w"}, {"n": 3}, {}], [{}]]
    p = profiles(spark, *people)
    verdict = {x.profile_id: x.verdict for x in E.evaluate(p, [rules]).collect()}
    got = {x.profile_id: json.loads(x.trace) for x in E.nested_trace(p, rules).collect()}
    assert {k: t["verdict"] for k, t in got.items()} == verdict
    node, depth = got[0]["inclusion"], 0
    while "children" in node:
        assert node["children"][1]["actual"] == 'say "hi"' and node["children"][1]["expected"] == ["x", "ü"]
        node, depth = node["children"][0], depth + 1
    assert depth == 8 and node == {"field": "a", "op": ">=", "expected": 3, "actual": "5.0", "result": True}
    count, single = got[0]["exclusions"]
    assert count["count"] == {"op": ">=", "count": 2, "low": 2, "high": 3} and count["result"] is None and count["except"]["actual"] is None
    assert [(m["member"], m["actual"], m["holds"]) for m in count["members"]] == [(0, "2.0", True), (1, "3.0", True), (2, None, None)]
    assert single["members"] == [{"member": 0, "actual": "w", "result": True, "except": {"field": "z", "op": "==", "expected": None, "actual": "null", "result": True}, "holds": False}]
    assert got[0]["requirements"] == ["photo", 'a "quoted" one'] and got[1]["exclusions"][0]["count"]["high"] == 1
