"""What keeps queries within their limits on larger tables: forms of plans, and the steps that give them."""

import datetime
import json
import pickle
import random
from dataclasses import replace

from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.test_evaluate import profiles, random_rules
from verdictlake import catalog
from verdictlake.llm import queries
from verdictlake.operators import evaluate, gate, indexed, ledger, questions, relational, retrieval
from verdictlake.operators.evaluate import ELIGIBLE, INELIGIBLE, UNDETERMINED
from verdictlake.plans import household, schema
from verdictlake.plans.rulesets import Exclusion, Leaf, Node, RuleSet, flat_table


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_template_query_has_the_columns_of_its_sql(spark):
    assert queries.QUERIES["op5_site_template"](spark, DATA).columns == ["page_id", "url", "text", "n_chars"]


def test_a_day_is_summed_without_sliding_frames(spark):
    rng, start = random.Random(3), datetime.datetime(2024, 1, 1)
    times = [None, None, *(start + datetime.timedelta(seconds=rng.choice([0, 1, 3599, 3600, 86399, 86400, 86401, rng.randrange(300_000)])) for _ in range(200))]
    rows = [(i, t, rng.choice([None, 1.0, 2.5, 4.0])) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "id LONG, ts TIMESTAMP, v DOUBLE")
    found = ledger.rolling_sum_by_day(df, "ts", "v", "s")
    rows = [(r.id, r.ts, r.v) for r in df.collect()]
    wanted = {}
    for i, t, _ in rows:
        near = [v for _, u, v in rows if v is not None and (u is None if t is None else u is not None and datetime.timedelta(0) <= t - u < datetime.timedelta(days=1))]
        wanted[i] = sum(near) if near else None
    assert {r.id: r.s for r in found.collect()} == wanted
    assert "unboundedpreceding" in plan(found) and "specifiedwindowframe(RangeFrame, -" not in plan(found)


def test_the_least_digests_are_found_by_counts(spark):
    rows = spark.range(3000).select(F.col("id").alias("scheme_id"), F.md5(F.col("id").cast("string")).alias("_s"), (F.col("id") % 7).alias("x"))
    rows = rows.unionByName(rows.where("scheme_id < 5"))
    order = rows.orderBy("_s", "scheme_id")
    for n in (0, 1, 2, 500, 2999, 3004, 3005, 5000):
        found = gate._least(rows, "_s", ["_s", "scheme_id"], n, few=20)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, order.limit(n).collect()))
        assert "GlobalLimit" not in plan(found)


def test_repeated_names_are_matched_once(spark):
    records = spark.createDataFrame([(i, i % 500, ("Big red house", "house Red big", "Small green hut", "old hut")[i % 4]) for i in range(2000)], "slug LONG, ordinal LONG, name STRING")
    targets = spark.createDataFrame([("big red house x",), ("green hut",), ("nothing",)], "target STRING")
    found = retrieval.fuzzy_match(targets, records, [], 0.5)
    assert {r.target: (r.slug, r.match_type) for r in found.collect()} == {"big red house x": (1500, "fuzzy"), "green hut": (1502, "fuzzy"), "nothing": (None, "none")}
    assert "min(ordinal" in plan(found) and "Aggregate [target#" in plan(found) and "slug#" not in plan(found).split("Aggregate [target#")[1].split("]")[0]


def test_screened_facts_are_dealt_by_key_before_they_are_grouped(spark):
    value = F.struct(F.lit("bool").alias("kind"), F.col("n").cast("double").alias("num"), F.lit(None).cast("string").alias("str"), F.lit(None).cast("array<string>").alias("arr"))
    rows = [(1, 0, "screen", 0), (1, 0, "screen", 0), (2, 0, "screen", 0), (2, 0, "secret", 1), (2, 0, "secret", 1), (3, 0, "screen", 1), (None, 0, "screen", 0), (None, 0, "secret", 1)]
    facts = spark.createDataFrame(rows, "profile_id LONG, member_ix INT, field STRING, n INT").withColumn("value", value).drop("n")
    fields = spark.createDataFrame([("secret", "screen"), ("plain", None)], "field STRING, screened_by STRING")
    found = questions.settle_screened(facts, fields)
    assert sorted((str(r.profile_id), r.field, r.value.num) for r in found.collect()) == sorted([*((str(a), f, float(n)) for a, _, f, n in rows), ("1", "secret", 0.0), ("None", "secret", 0.0)])
    assert "LeftAnti" not in plan(found) and "RepartitionByExpression" in plan(found)


def test_verdicts_side_by_side_need_no_join(spark):
    for name in ("verdict_differences", "pairwise_agreement"):
        text = plan(catalog.QUERIES[name](spark, DATA))
        assert "Join" not in text and text.count("l_orderkey") == plan(catalog.QUERIES["direct_answers"](spark, DATA)).count("l_orderkey"), name


def test_households_travel_as_plain_columns(spark):
    below = plan(catalog.QUERIES["direct_answers"](spark, DATA)).split("collect_list")[1].split("Union")[1]
    assert "map" not in below.lower()


def test_traces_build_the_columns_asked_for(spark):
    assert "priority IN" not in plan(catalog.QUERIES["eval_trace_leaves"](spark, DATA)) and "actual" not in plan(catalog.QUERIES["eval_trace_leaves"](spark, DATA))


def test_stored_facts_are_dealt_before_they_are_summed(spark):
    assert "RepartitionByExpression [id" in plan(catalog.QUERIES["reused_after_renames"](spark, DATA))


def test_schema_checks_run_in_many_tasks(spark):
    rows = spark.range(40).select(F.col("id").cast("string").alias("scheme_id"), F.lit("{").alias("rules")).coalesce(1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = schema.schema_faults(rows)
        assert found.count() == 40 and found.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_traces_evaluate_each_exclusion_once(spark):
    rules = RuleSet("s", Leaf("ok", "==", True), tuple(Exclusion(f"f{i}", ">=", i, quantifier="some_family_member") for i in range(3)))
    people = profiles(spark, [{"ok": True, "f0": 1}, {"f1": 'a"b', "f2": 7}])
    found = evaluate.nested_trace(people, rules)
    assert plan(found).count("exists(") == 3
    members = [m["actual"] for x in json.loads(found.first().trace)["exclusions"] for m in x["members"]]
    assert members == ["1.0", None, None, 'a"b', None, "7.0"]


def test_a_task_has_one_chat_with_households_of_a_kind(spark):
    people = [[{"age": float(a)}, {"works": w}] for a in (*range(10, 60), *range(10, 60)) for w in (True, False, None)]
    rules = RuleSet("s", Leaf("age", ">=", 18), (Exclusion("works", "==", True, quantifier="some_family_member"),))
    found = questions.simulated_chats(profiles(spark, *people).coalesce(1), rules)
    assert "said" in plan(found)
    got = {r.profile_id: (r.verdict, r.asked) for r in found.collect()}
    for i, (me, other) in enumerate(people):
        reaches = {f: questions.Reach(rules, f) for f in ("age", "works")}
        assert got[i] == questions.chat(rules, [me, other], (), reaches)


def test_rule_sets_that_differ_in_a_threshold_are_counted_together(spark, monkeypatch):
    monkeypatch.setattr(indexed, "HELD", 200)  # verdicts are added up several times a task
    monkeypatch.setattr(indexed, "SWEPT", 60)  # a class's thresholds are dealt over parts
    rng, ops = random.Random(4), ["<", "<=", ">", ">=", "==", "!="]
    sets = [RuleSet(f"s{i}", Node("and", (Leaf("a", ops[i % 6], i // 6), Node("or", (Leaf("b", "==", True), Leaf("a", "<", 12))))), (Exclusion("c", ">=", 5, quantifier="some_family_member"),)) for i in range(120)]
    sets += [RuleSet("same", sets[0].inclusion, sets[0].exclusions), RuleSet("text", Leaf("a", "<", "n")), RuleSet("bare", Leaf("b", "==", True))]
    values = {"a": [None, "x", True, -1, *range(25), 3.5, float("nan"), float("inf")], "b": [True, False], "c": [1, 9, None]}
    p = profiles(spark, *[[{f: rng.choice(v) for f, v in values.items() if rng.random() < 0.8} for _ in range(rng.randint(1, 3))] for _ in range(150)])
    flat = flat_table(spark, sets)
    assert indexed.classes(flat).select("class").distinct().count() == 8
    wanted = {s.scheme_id: [0, 0, 0] for s in sets}
    for x in indexed.verdicts(p, flat).collect():
        wanted[x.scheme_id][[ELIGIBLE, INELIGIBLE, UNDETERMINED].index(x.verdict)] += 1
    assert {x.scheme_id: [x.eligible, x.ineligible, x.undetermined] for x in indexed.tallies(p, flat).collect()} == wanted


def test_relational_verdicts_deal_profiles_once(spark):
    flat = flat_table(spark, [household.H1, household.H2])
    found = relational.verdicts(household.profiles(spark, DATA), flat)
    wanted = {(x.profile_id, x.scheme_id): x.verdict for x in evaluate.evaluate(household.profiles(spark, DATA), [household.H1, household.H2]).collect()}
    assert {(x.profile_id, x.scheme_id): x.verdict for x in found.collect()} == wanted
    plan_ = found._jdf.queryExecution().executedPlan().toString().split("Final Plan")[-1].split("Initial Plan")[0]
    assert "SortMergeJoin" not in plan_ and plan_.count("hashpartitioning(profile_id") == 1


def test_a_few_rules_from_a_table_are_folded_in_the_households_row(spark, monkeypatch):
    rng = random.Random(5)
    leaf = lambda: Leaf(rng.choice("abc"), rng.choice(["==", "!=", "<", "<=", ">", ">=", "in", "not_in"]), rng.choice([1, 5.0, True, "x", ["x", 5], None, float("inf")]))
    sets = [RuleSet(f"s{i}", Node(rng.choice(["and", "or"]), (leaf(), Node("or", (leaf(), leaf())))), (Exclusion("c", ">=", 5, quantifier=q, count_op="<=", count=1, exception=leaf(), except_scope=rng.choice(["member", "applicant"])), Exclusion("b", "==", True))) for i, q in enumerate(["self", "some_family_member", "all_family_members", "count_family_members"])]
    values = {"a": [1, 5, 9, None, "x", float("inf"), float("nan")], "b": [True, False, 1, "x"], "c": [1, 9, "x", ["x"]]}
    people = [[{f: rng.choice(v) for f, v in values.items() if rng.random() < 0.7} for _ in range(rng.randint(0, 4))] for _ in range(80)] + [[None, {"a": 1, "c": 9}], [None, {}, {"c": 1}]]
    p, flat = profiles(spark, *people), flat_table(spark, sets)
    found = relational.verdicts(p, flat)
    assert "Join" not in plan(found) and "Aggregate" not in plan(found)
    got = {(x.profile_id, x.scheme_id): (x.verdict, x.included, x.excluded) for x in found.collect()}
    compiled = {(x.profile_id, x.scheme_id): (x.verdict, x.included, x.excluded) for x in evaluate.evaluate(p, sets).where("error IS NULL").collect()}
    assert len(got) == len(people) * len(sets) and all(got[k] == v for k, v in compiled.items() if not any(isinstance(x, list) for m in people[k[0]] if m for x in m.values()))
    odd = flat.unionByName(flat.limit(1))  # a rule twice: joined, as is what no rule set gives
    assert "Join" in plan(relational.verdicts(p, odd))
    monkeypatch.setattr(relational, "COMPILED", 3)
    joined = relational.verdicts(p, flat)
    assert "Join" in plan(joined)
    assert {(x.profile_id, x.scheme_id): (x.verdict, x.included, x.excluded) for x in joined.collect()} == got


def test_chats_see_texts_instead_of_households(spark):
    rng = random.Random(6)
    for n in range(5):
        rules = random_rules(rng, n)
        people = [[{f: rng.choice([0, 1, 2, True, None, "x"]) for f in "abc" if rng.random() < 0.6} for _ in range(rng.randint(1, 3))] for _ in range(30)]
        found = questions.compared_chats(profiles(spark, *people), rules)
        got = {(x.profile_id, x.relevance): (x.verdict, x.asked) for x in found.collect()}
        reaches = {f: questions.Reach(rules, f) for f in "abc"}
        assert got == {(i, on): questions.chat(rules, p, (), reaches if on else None) for i, p in enumerate(people) for on in (False, True)}
    text = plan(catalog.QUERIES["chat_questions"](spark, DATA))
    sent = text.split("MapInArrow")[1].split("\n")[1]
    assert text.count("MapInArrow") == 1 and "Union" not in text.split("MapInArrow")[0] and "said" in sent and "_fam" not in sent


def test_what_rule_sets_share_is_evaluated_once_and_sent_without_the_driver(spark, monkeypatch):
    built = {}
    monkeypatch.setattr(indexed, "pickle", type("P", (), {"dumps": pickle.dumps, "loads": staticmethod(lambda data: built.setdefault(data, pickle.loads(data)))}))
    found = catalog.QUERIES["eval_indexed"](spark, DATA)
    index = next(iter(built.values()))
    assert len(index.schemes) > 40 and index.own.n <= 6 and index.family.n <= 61 and len(index.held) <= 60
    assert "strategy=broadcast" not in plan(found) and "binary" not in plan(found)
    wanted = sorted(found.collect())
    monkeypatch.setattr(indexed, "SENT", 0)  # blocks of any size, that the driver never sees
    assert sorted(catalog.QUERIES["eval_indexed"](spark, DATA).collect()) == wanted


def test_classes_compare_whole_rule_sets(spark):
    base = RuleSet("s", Node("and", (Leaf("a", ">=", 1), Leaf("b", "in", ["x", None]))), (Exclusion("c", "==", True, exception=Leaf("d", "==", 2)),))
    like = [base, replace(base, inclusion=Node("and", (Leaf("a", ">=", 2), Leaf("b", "in", ["x", None])))), replace(base, inclusion=Node("and", (Leaf("a", ">=", 7.5), Leaf("b", "in", ["x", None]))))]
    other = [replace(base, inclusion=Node("or", base.inclusion.children)), replace(base, inclusion=Node("and", (Leaf("a", ">=", 1), Leaf("b", "in", [None, "x"])))), replace(base, inclusion=Node("and", (Leaf("a", ">", 1), base.inclusion.children[1])))]
    other += [replace(base, exclusions=(replace(base.exclusions[0], **x),)) for x in ({"except_scope": "applicant"}, {"quantifier": "some_family_member"}, {"exception": Leaf("d", "==", 3)}, {"exception": None}, {"field": "d"}, {"value": "True"})]
    flat = flat_table(spark, [replace(x, scheme_id=f"{k}{i}") for k, some in (("like", like), ("other", other)) for i, x in enumerate(some)])
    got = {x.scheme_id: (x["class"], x.threshold, x.swept) for x in indexed.classes(flat).collect()}
    assert [got[f"like{i}"][1] for i in range(3)] == [1, 2, 7.5] and len({got[f"like{i}"][0] for i in range(3)}) == 1
    assert len({x[0] for x in got.values()}) == 1 + len(other) and {x[2] for x in got.values()} == {"inclusion.and[0]", "inclusion.or[0]"}
