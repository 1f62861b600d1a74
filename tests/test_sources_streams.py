"""Files in and out, and streams against their batch forms."""

import json

from pyspark.sql import functions as F

from tests.conftest import DATA
from verdictlake.functions import text as T
from verdictlake.functions.mojibake import fix_mojibake
from verdictlake.operators import confidence, gate, ledger, retrieval, rules, scoring
from verdictlake.plans import household as H
from verdictlake.plans import rulesets
from verdictlake.plans.rulesets import flat_table
from verdictlake.sources import files
from verdictlake.streaming import streams


def test_rule_sets_and_profiles(spark, tmp_path):
    files.write_rule_sets(spark, [H.H1], str(tmp_path / "out"))
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "h1.json").write_text(next((tmp_path / "out").glob("part-*")).read_text())
    assert files.read_rule_sets(spark, str(tmp_path / "rules")) == [H.H1]
    assert files.read_rule_table(spark, str(tmp_path / "rules")).count() == len(rulesets.flat_rows(H.H1))
    (tmp_path / "people").mkdir()
    (tmp_path / "people" / "suite.json").write_text(json.dumps({"_note": {}, "p1": {"self": {"age": 40, "ok": True, "gone": None, "name": "x", "tags": ["a", "b"]}, "family_members": [{"age": 2.5}]}, "p2": {}}))
    rows = {r.profile_id: r.members for r in files.read_profiles(spark, str(tmp_path / "people")).collect()}
    assert set(rows) == {"p1", "p2"}
    me = rows["p1"][0].facts
    assert (me["age"].kind, me["age"].num, me["ok"].kind, me["ok"].num, me["gone"].kind, me["name"].str, me["tags"].arr) == ("num", 40.0, "bool", 1.0, "null", "x", ["s:a", "s:b"])
    assert rows["p1"][1].facts["age"].num == 2.5 and rows["p2"][0].facts == {}


def test_corpus_and_runs(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.txt").write_text("doc_id: d1\neffective_date: 2020-01-02\n\nshort\n\nA paragraph that is long enough.\n\nAnother paragraph, long enough too.")
    rows = files.read_corpus(spark, str(tmp_path / "c")).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.header["doc_id"], str(r.effective_date), r.text[:9]) for r in rows] == [(0, "d1", "2020-01-02", "A paragra"), (1, "d1", "2020-01-02", "Another p")]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "1.json").write_text(json.dumps({"scheme_id": "s", "draft": {"x": 1}, "repaired": {"x": 2}}))
    assert files.read_runs(spark, str(tmp_path / "r")).select("stage", "rules").first()[:] == ("repaired", '{"x":2}')


def test_review_sheet(spark, tmp_path):
    rows = spark.createDataFrame([("a", "src", "x"), ("b", "src", "y")], "key STRING, source STRING, text STRING")
    files.export_review(rows, None, str(tmp_path / "s"))
    sheet = spark.createDataFrame([("a", "x", "ok", None), ("b", "old", "FIX", "z")], "key STRING, text STRING, answer STRING, fix STRING")
    sheet.coalesce(1).write.option("header", True).csv(str(tmp_path / "in"))
    current = spark.createDataFrame([("a", "x", "machine"), ("b", "y", "machine"), ("c", "w", "machine")], "key STRING, text STRING, status STRING")
    got = {r.key: (r.text, r.status, r.outcome) for r in files.import_review(spark, str(tmp_path / "in"), current).collect()}
    assert got == {"a": ("x", "reviewed", "reviewed"), "b": ("y", "machine", "text changed since"), "c": ("w", "machine", "no answer")}


def test_text_functions(spark):
    row = spark.createDataFrame([("4५ என", "Prefer not to say!", "जी हाँ", "The “quote”  was long enough here – yes", "x")], "a STRING, b STRING, c STRING, d STRING, e STRING")
    got = row.select(T.ascii_digits(F.col("a")), T.script_language(F.col("a")), T.is_decline(F.col("b")), T.parse_boolean(F.col("c")), T.parse_boolean(F.col("e")), T.quote_is_verbatim(F.lit("was long enough ... HERE - yes"), F.col("d")), T.parse_number(F.lit("४५.5")), T.number_is_grounded(F.lit(10000), F.lit("up from Rs. 10,000)")), T.value_is_grounded(F.struct(F.lit("bool").alias("kind"), F.lit(0.0).alias("num"), F.lit(None).cast("string").alias("str")), F.lit("0 false"))).first()
    assert tuple(got) == ("45 என", "ta", True, True, None, True, 45.5, True, False)
    damaged = spark.createDataFrame([("itâ€™s",), ("café",), ("﻿plain",), (None,)], "t STRING")
    assert {r.t for r in fix_mojibake(damaged, "t").collect()} == {"it’s", "café", "plain", None}


def test_catalogue_and_ledger(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"slug":"a","scheme_name":"itâ€™s","description":" "}\n\n{"slug":"b","scheme_name":"café","description":"d"}\n')
    read = files.read_catalogue(spark, str(tmp_path / "in.jsonl"))
    assert {r.slug: r.scheme_name for r in read.collect()} == {"a": "it’s", "b": "café"}
    assert files.write_catalogue(read, str(tmp_path / "out")).select("n", "scheme_name_filled", "description_filled").first()[:] == (2, 1.0, 0.5)
    assert {r.slug for r in files.read_catalogue(spark, str(tmp_path / "out")).collect()} == {"a", "b"}
    for n in (1, 2):
        files.append_ledger(spark.range(n), str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 3


def test_mojibake_repair_against_pythons_codec(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    damaged = {i: (t.encode("utf-8").decode("cp1252", errors="ignore") + " â€”") if i % 2 else t for i, t in texts.items()}
    got = {r.doc_id: r.text for r in fix_mojibake(spark.createDataFrame(list(damaged.items()), "doc_id LONG, text STRING"), "text").collect()}
    for i, t in damaged.items():
        want = t.encode("cp1252", errors="ignore").decode("utf-8", errors="ignore") if "â" in t else t
        assert got[i] == want.replace("\ufeff", "")


def test_pairing_of_two_bounds(spark):
    flat = "scheme_id STRING, ordinal INT, location STRING, field STRING, cat STRING, op STRING, value_repr STRING, quantifier STRING, parent_field STRING, except_scope STRING"
    gold = spark.createDataFrame([("s", 0, "inclusion", "age", "demographic", ">=", "18", None, None, None), ("s", 1, "inclusion", "age", "demographic", "<=", "40", None, None, None), ("s", 2, "inclusion", "x", "other", "==", "1", None, None, None)], flat)
    draft = spark.createDataFrame([("s", 0, "inclusion", "age", "demographic", "<=", "40", None, None, None), ("s", 1, "inclusion", "age", "economic", ">=", "21", None, None, None), ("s", 2, "exclusion", "y", "economic", "==", "1", "self", None, None)], flat)
    pairs = scoring.paired(gold, draft)
    assert sorted(r.label for r in pairs.collect()) == ["exact", "hallucinated", "missing", "present_but_wrong"]
    got = {r.category: (r.tp, r.fp, r.fn) for r in scoring.structural_score(pairs).collect()}
    assert got == {"demographic": (1, 1, 1), "other": (0, 0, 1), "economic": (0, 1, 0), "__overall__": (1, 2, 2)}
    assert scoring.category_disagreements(pairs).count() == 1


def test_gate_and_mutations(spark):
    doc = "The limit was raised to Rs. 15,000 (up from Rs. 10,000) this year."
    value = "STRUCT<kind: STRING, num: DOUBLE, str: STRING, arr: ARRAY<STRING>>"
    rows = spark.createDataFrame([(1, "temporal_supersession", "raised to Rs. 15,000", 0.95, doc, ("num", 10000.0, None, None), None), (2, "temporal_supersession", "raised to Rs. 15,000", 0.95, doc, ("bool", 0.0, None, None), None), (3, "preambular_implied_fact", "made up words here", 0.99, doc, None, None), (4, "preambular_implied_fact", "this year.", 0.75, doc, None, False)], f"id INT, category STRING, quote STRING, confidence DOUBLE, document STRING, retired {value}, consistent BOOLEAN")
    got = {r.id: r.decision for r in gate.decide(rows).collect()}
    assert got == {1: "auto_accept", 2: "defer_to_review", 3: "defer_to_review", 4: "defer_to_review"}
    flat = flat_table(spark, [H.H1, H.H2])
    drawn = gate.draw_mutations(gate.mutation_candidates(flat))
    assert drawn.collect() == gate.draw_mutations(gate.mutation_candidates(flat)).collect()
    assert drawn.groupBy("scheme_id", "ordinal").count().where("count > 1").isEmpty() and drawn.groupBy("scheme_id", "variant").count().where("count > 3").isEmpty()
    checked = rules.validate_flat(gate.mutate(flat, drawn).drop("variant"))
    assert checked.where(F.size("faults") > 0).isEmpty() and checked.count() > 0


def test_confidence_edges(spark):
    points = spark.createDataFrame([(0.1, True), (0.335, True), (1.0, False)], "confidence DOUBLE, correct BOOLEAN")
    got = {(r.lo, r.hi): r.n for r in confidence.ece_bins(points, [(0.0, 0.33), (0.34, 0.66), (0.67, 1.0)]).collect()}
    assert got == {(0.0, 0.33): 1, (0.34, 0.66): 0, (0.67, 1.0): 1}
    flat = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 5), ("b", 1, 1), ("b", 2, 3), ("b", 3, 2), ("c", 1, 1)], "g STRING, x INT, y INT")
    assert {r.g: r.rho for r in confidence.spearman(flat, "x", "y", ["g"]).collect()} == {"a": None, "b": 0.5, "c": None}


def test_retrieval_edges(spark):
    chunks = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 3), ("c", None)], "doc STRING, effective_date INT")
    got = sorted((r.doc, r.effective_date) for r in retrieval.latest_version(chunks, "doc", F.lit(2)).collect())
    assert got == [("a", 2), ("c", None)]
    records = spark.createDataFrame([("x", 1, "Old Age Pension Sikkim"), ("y", 2, "NSAP Old Age Pension"), ("z", 3, "Something Else")], "slug STRING, ordinal INT, name STRING")
    targets = spark.createDataFrame([("Old Age Pension",), ("something (new) else",), ("Nothing here",)], "target STRING")
    got = {r.target: (r.slug, r.match_type) for r in retrieval.fuzzy_match(targets, records, ["sikkim"]).collect()}
    assert got == {"Old Age Pension": ("y", "fuzzy"), "something (new) else": ("z", "exact"), "Nothing here": (None, "none")}
    page = spark.createDataFrame([("Intro Benefits b1 Eligibility e1 Sources s1",)], "t STRING")
    parts = retrieval.anchor_sections(F.col("t"), [("benefits", "Benefits"), ("exclusions", "Exclusions"), ("eligibility", "Eligibility"), ("sources", "Sources")])
    assert page.select(*[c.alias(n) for n, c in parts.items()]).first().asDict() == {"intro": "Intro", "benefits": "b1", "exclusions": None, "eligibility": "e1", "sources": "s1"}
    md = spark.createDataFrame([("<!-- c -->\n# T\n## Who\nA\nB\n## How\nC",)], "t STRING").select(retrieval.markdown_sections(F.col("t"))).first()[0]
    assert [(s.heading, s.body) for s in md] == [("who", "A\nB"), ("how", "C")]


def test_answer_stream_equals_batch(spark, tmp_path):
    rows = [(1, "a", 1.0, "2024-01-01 00:00:01", 1), (1, "a", 2.0, "2024-01-01 00:00:03", 3), (1, "a", 9.0, "2024-01-01 00:00:02", 2), (2, "s", 0.0, "2024-01-01 00:00:01", 4), (2, "b", None, "2024-01-01 00:00:05", 5)]
    df = spark.createDataFrame(rows, "profile_id LONG, field STRING, value DOUBLE, ts STRING, event_id LONG").withColumn("ts", F.to_timestamp("ts"))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.where("event_id < 3").coalesce(1).write.parquet(src)
    df.where("event_id >= 3").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    facts = streams.current_facts(stream, {"s": ["t"]})
    streams.each_batch(facts, lambda b, i: b.write.mode("overwrite").parquet(f"{out}/{i}"), str(tmp_path / "cp"))
    changes = spark.read.parquet(f"{out}/*")
    got = {(r.profile_id, r.field): r.value for r in ledger.fold_answers(changes, ["profile_id"], "field", "value", "version", "version").collect()}
    batch = {(r.profile_id, r.field): r.value for r in ledger.fold_answers(df, ["profile_id"], "field", "value", "ts", "event_id").collect()}
    assert got == batch | {(2, "t"): 0.0}


def test_answer_stream_with_late_dependants_and_changed_screens(spark, tmp_path):
    files = [[(1, "s", 0.0, 10, 1), (2, "s", 0.0, 10, 2), (3, "s", 0.0, 10, 3)], [(1, "t", 7.0, 5, 4), (2, "s", 1.0, 20, 5)], [(3, "t", 3.0, 30, 6), (3, "s", 1.0, 40, 7), (2, "u", 5.0, 1, 8)]]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in files:
        df = spark.createDataFrame(rows, "profile_id LONG, field STRING, value DOUBLE, s LONG, event_id LONG")
        df = df.select("profile_id", "field", "value", F.timestamp_seconds("s").alias("ts"), "event_id")
        df.coalesce(1).write.mode("append").parquet(src)
        streams.each_batch(streams.current_facts(spark.readStream.schema(df.schema).parquet(src), {"s": ["t"]}), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/{i}"), str(tmp_path / "cp"))
    changes = spark.read.parquet(f"{out}/*")
    got = {(r.profile_id, r.field): r.value for r in ledger.fold_answers(changes, ["profile_id"], "field", "value", "version", "version").collect()}
    assert got == {(1, "s"): 0.0, (1, "t"): 7.0, (2, "s"): 1.0, (2, "t"): None, (2, "u"): 5.0, (3, "s"): 1.0, (3, "t"): 3.0}


def test_usage_stream(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:01", 5.0), ("2024-01-01 00:00:30", 7.0)], "ts STRING, tokens DOUBLE").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    minute, _ = streams.usage_windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 10.0, 100.0)
    out = str(tmp_path / "out")
    streams.each_batch(minute, lambda b, i: b.write.mode("overwrite").parquet(f"{out}/{i}"), str(tmp_path / "cp"))
    assert spark.read.parquet(f"{out}/*").where("exceeded").agg(F.max("tokens"), F.count("*")).first()[:] == (12.0, 31)


def test_ledger_edges(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (2, "2024-01-02 00:00:00", 2.0), (3, "2024-01-02 12:00:00", 4.0)], "id INT, ts STRING, v DOUBLE").withColumn("ts", F.to_timestamp("ts"))
    assert {r.id: r.s for r in ledger.rolling_sum_by_day(df, "ts", "v", "s").collect()} == {1: 1.0, 2: 2.0, 3: 6.0}
    assert ledger.seconds_to_headroom(df.limit(0), "ts", "v", F.lit("2024-01-03 00:00:00"), 5.0, 1.0).first()[0] == 0.0
    runs = spark.createDataFrame([("s", "gated", "f1"), ("s", "judged", "f9"), ("t", "plain", "f2"), ("t", "plain", "f3")], "scheme_id STRING, stage STRING, file STRING")
    assert {r.scheme_id: r.file for r in ledger.prefer_stage(runs, ["scheme_id"], "stage", ["gated", "judged", "plain"], "file").collect()} == {"s": "f1", "t": "f3"}


def test_verdict_stream_equals_batch(spark, tmp_path):
    """Late, repeated and retracted answers over several runs of the stream from one checkpoint."""
    import random

    from verdictlake.functions import values
    from verdictlake.operators import evaluate
    from verdictlake.plans.rulesets import Exclusion, Leaf, Node, RuleSet

    rule_sets = [
        RuleSet("x", Node("and", (Leaf("age", ">=", 60), Node("or", (Leaf("poor", "==", True), Leaf("income", "<", 5))))), (Exclusion("taxed", "==", True),)),
        RuleSet("y", Leaf("income", ">=", 5), (Exclusion("age", "<", 18, quantifier="some_family_member", exception=Leaf("poor", "==", True)),)),
    ]
    r = random.Random(5)
    answers = [(r.randrange(12), *r.choice([("age", r.choice([10.0, 61.0, None])), ("poor", r.choice([0.0, 1.0])), ("income", r.choice([3.0, 7.0, None])), ("taxed", r.choice([0.0, 1.0]))]), 1_700_000_000 + r.randrange(500), i) for i in range(300)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for start in (0, 90, 140):
            rows = answers[start : {0: 90, 90: 140, 140: 300}[start]]
            df = spark.createDataFrame(rows, "profile_id LONG, field STRING, value DOUBLE, s LONG, event_id LONG")
            df = df.select("profile_id", "field", "value", F.timestamp_seconds("s").alias("ts"), "event_id")
            df.coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
            streams.each_batch(streams.verdict_changes(stream, rule_sets, {"poor": ["taxed"]}), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/{i}"), str(tmp_path / "cp"))
    finally:
        spark.conf.unset(name)
    changes = spark.read.parquet(f"{out}/*").collect()
    by = {}
    for c in sorted(changes, key=lambda c: c.version):
        assert c.before == by.get((c.profile_id, c.scheme_id), (None, 0))[0] and c.version == by.get((c.profile_id, c.scheme_id), (None, 0))[1] + 1 and c.verdict != c.before
        by[c.profile_id, c.scheme_id] = (c.verdict, c.version)
    known = {}
    for profile, field, value, s, event in sorted(answers, key=lambda a: (a[3], a[4])):
        known.setdefault(profile, {})[field] = value
    for facts in known.values():
        if facts.get("poor") == 0.0 and "taxed" not in facts:
            facts["taxed"] = 0.0
    people = [(p, [(0, {f: values.tagged(v) for f, v in facts.items() if v is not None})]) for p, facts in known.items()]
    profiles = spark.createDataFrame(people, f"profile_id LONG, members ARRAY<STRUCT<ix: INT, facts: MAP<STRING, {values.DDL}>>>")
    assert {k: v[0] for k, v in by.items()} == {(x.profile_id, x.scheme_id): x.verdict for x in evaluate.evaluate(profiles, rule_sets).collect()}
