"""Queries over rules as data, explanations, intake and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.catalog_base import query, read
from verdictlake.catalog_text import _words
from verdictlake.functions.values import of_num
from verdictlake.operators import evaluate, gate, intake, relational, reports
from verdictlake.plans import household as H
from verdictlake.plans.rulesets import flat_table, flatten_json


_quoted = lambda c: f"""coalesce('"' || ({c})::VARCHAR || '"', 'null')"""
_trit = lambda c: f"coalesce(({c})::VARCHAR, 'null')"


def _leaf_json(field: str, op: str, expected: str, actual: str, result: str) -> str:
    return f"""'{{"field":"{field}","op":"{op}","expected":{expected},"actual":' || {_quoted(actual)} || ',"result":' || {_trit(result)} || '}}'"""


def _member_json(actual: str, result: str, spared: str = "", holds: str = "") -> str:
    return f"""'{{"member":' || ix || ',"actual":' || {_quoted(actual)} || ',"result":' || {_trit(result)} || {spared}',"holds":' || {_trit(holds or result)} || '}}'"""


def _exclusion_json(field: str, op: str, expected: str, quantifier: str, result: str, more: str, members: str) -> str:
    return f"""'{{"field":"{field}","op":"{op}","expected":{expected},"quantifier":"{quantifier}","result":' || {_trit(result)} || {more}',"members":[' || {members} || ']}}'"""


_SPARED = f"""',"except":' || {_leaf_json("discount", ">=", "0.09", "disc", "disc >= 0.09")} || """
_COUNTED = f"""',"count":{{"op":">=","count":2,"low":' || low || ',"high":' || high || '}},"except":' || {_leaf_json("total_price", ">=", "300000", "price", "price >= 300000")} || """
_TRACES = f"""mem AS (SELECT o_orderkey AS k, 0 AS ix, FALSE AS ret, CASE WHEN o_orderkey % 11 <> 0 THEN 0::DOUBLE END AS disc, 0::DOUBLE AS qty, 1::DOUBLE AS tax FROM orders
  UNION ALL SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 13 <> 0 THEN l_returnflag = 'R' END, l_discount, CASE WHEN l_suppkey % 17 <> 0 THEN l_quantity END, l_tax FROM lineitem),
mt AS (SELECT k, ix, {_member_json("ret", "ret", _SPARED, "ret AND NOT disc >= 0.09")} AS t1, {_member_json("qty", "qty >= 45")} AS t2, {_member_json("tax", "tax > 0.06")} AS t3 FROM mem),
ms AS (SELECT k, string_agg(t1, ',' ORDER BY ix, t1) AS m1, string_agg(t2, ',' ORDER BY ix, t2) AS m2, string_agg(t3, ',' ORDER BY ix, t3) AS m3 FROM mt GROUP BY 1)"""


def register(counts: str) -> None:
    """Queries whose SQL rests on the household's verdicts."""

    @query(f"""WITH {counts}, {_TRACES}, o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority FROM orders)
SELECT t.profile_id, 'H1' AS scheme_id, '{{"verdict":"' || verdict || '","inclusion":{{"kind":"and","result":' || {_trit("inc")} || ',"children":[' || {_leaf_json("total_price", ">=", "50000", "price", "price >= 50000")} || ',{{"kind":"or","result":' || {_trit("urgent OR status = 'F'")} || ',"children":['
|| {_leaf_json("priority", "in", '["1-URGENT", "2-HIGH"]', "priority", "urgent")} || ',' || {_leaf_json("status", "==", '"F"', "status", "status = 'F'")} || ']}}]}},"exclusions":[' || {_exclusion_json("returned", "==", "true", "some_family_member", "x1", "", "m1")} || ','
|| {_exclusion_json("quantity", ">=", "45", "count_family_members", "many AND NOT price >= 300000", _COUNTED, "m2")} || ',' || {_exclusion_json("tax", ">", "0.06", "all_family_members", "x3", "", "m3")} || '],"requirements":["photo identity"]}}' AS trace
FROM tested t JOIN verdicts v ON v.profile_id = t.profile_id AND v.scheme_id = 'H1' JOIN ms ON ms.k = t.profile_id JOIN o ON o.o_orderkey = t.profile_id""")
    def nested_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Every order's trace through the household rules, as nested JSON."""
        return evaluate.nested_trace(H.profiles(spark, sf_dir), H.H1)

    @query(f"WITH {counts} SELECT profile_id, scheme_id, verdict, inc AS included, exc AS excluded FROM verdicts")
    def eval_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The household rule sets as rows of a table, folded by joins: the same verdicts as the compiled ones."""
        return relational.verdicts(H.profiles(spark, sf_dir), flat_table(spark, [H.H1, H.H2, H.H3]))

    @query(f"""WITH {counts}, m AS (SELECT l_orderkey AS k, bool_or(coalesce(CASE WHEN l_partkey % 13 <> 0 THEN l_returnflag = 'R' END AND l_discount >= 0.09, FALSE)) AS w1 FROM lineitem GROUP BY 1)
SELECT profile_id, '- All of:' || chr(10) || '  - Total price: ' || CASE WHEN price >= 50000 THEN 'met' ELSE 'not met' END || chr(10) || '  - One of:' || chr(10) || '    - Priority: ' || CASE WHEN urgent THEN 'met' WHEN NOT urgent THEN 'not met' ELSE 'unknown' END || chr(10) || '    - Status: ' || CASE WHEN status = 'F' THEN 'met' ELSE 'not met' END
|| chr(10) || '- Returned: ' || CASE WHEN x1 THEN 'applies' WHEN NOT x1 THEN CASE WHEN coalesce(w1, FALSE) THEN 'waived' ELSE 'does not apply' END ELSE 'unknown' END
|| chr(10) || '- Quantity: ' || CASE WHEN many AND NOT price >= 300000 THEN 'applies' WHEN NOT (many AND NOT price >= 300000) THEN CASE WHEN many AND price >= 300000 THEN 'waived' ELSE 'does not apply' END ELSE 'unknown' END
|| chr(10) || '- Tax: ' || CASE WHEN x3 THEN 'applies' ELSE 'does not apply' END AS explanation FROM tested LEFT JOIN m ON m.k = profile_id""")
    def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evaluate.explain(H.profiles(spark, sf_dir), H.H1)

    @query(f"WITH {counts} SELECT a.profile_id, a.verdict AS first, b.verdict AS second FROM verdicts a JOIN verdicts b ON a.profile_id = b.profile_id AND a.scheme_id = 'H1' AND b.scheme_id = 'H3' WHERE a.verdict <> b.verdict")
    def verdict_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reports.differing(evaluate.verdict_pairs(H.profiles(spark, sf_dir), H.H1, H.H3))


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer)
SELECT k AS scheme_id, 0 AS ordinal, 'inclusion.and[0]' AS path, 'inclusion' AS location, 'age' AS field, '>=' AS op, k::VARCHAR AS value_json, NULL AS quantifier, NULL AS parent_field, NULL AS except_scope FROM c
UNION ALL SELECT k, 1, 'inclusion.and[1].or[0]', 'inclusion', 'f' || n, '==', 'true', NULL, NULL, NULL FROM c UNION ALL SELECT k, 2, 'inclusion.and[1].or[1]', 'inclusion', 'caste', 'in', '["a","b"]', NULL, NULL, NULL FROM c
UNION ALL SELECT k, 3, 'exclusions[0]', 'exclusion', 'tax', '==', 'true', CASE WHEN n % 2 = 0 THEN 'self' ELSE 'some_family_member' END, NULL, NULL FROM c WHERE k % 3 <> 0
UNION ALL SELECT k, 4, 'exclusions[0].except', 'exception', 'old', '>=', '60', NULL, 'tax', 'member' FROM c WHERE k % 3 <> 0 AND n % 4 = 0""")
def flattened_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rule sets in JSON, opened into predicates."""
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey")
    tree = put('{"inclusion":{"and":[{"field":"age","op":">=","value":', k, '},{"or":[{"field":"f', n.cast("string"), '","op":"==","value":true},{"field":"caste","op":"in","value":["a","b"]}]}]}')
    spared = F.when(n % 4 == 0, ',"except":{"field":"old","op":">=","value":60}').otherwise("")
    out = put(',"exclusions":[{"field":"tax","op":"==","value":true', F.when(n % 2 == 0, "").otherwise(',"quantifier":"some_family_member"'), spared, "}]")
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scheme_id"), put(tree, F.when(F.col("c_custkey") % 3 != 0, out).otherwise(""), "}").alias("rules"))
    return flatten_json(rows)


_KIND = _words("l_linenumber", "dropped_predicate", "flipped_operator", "threshold")


@query(f"""WITH e AS (SELECT l_orderkey AS error_id, l_linenumber AS n, l_suppkey AS scheme_id, {_KIND} AS kind, 'f' || l_partkey % 4 AS field, '>=' AS op, CAST(l_quantity AS INT) % 3 AS value FROM lineitem),
res AS (SELECT s_suppkey AS scheme_id, s_suppkey % 5 = 0 AS failed FROM supplier WHERE s_suppkey % 7 <> 0),
fi AS (SELECT ps AS scheme_id, ordinal, CASE WHEN ordinal % 3 <> 0 THEN 'f' || ordinal % 4 END AS pf, CASE WHEN ordinal % 3 = 0 THEN 'f' || ordinal % 4 END AS rf, CASE WHEN ordinal % 2 = 0 THEN '>=' ELSE '<' END AS op, ordinal % 3 AS value, CASE WHEN ordinal % 5 < 2 THEN 'defer_to_review' ELSE 'auto_accept' END AS decision FROM (SELECT p_partkey % 50 AS ps, p_partkey AS ordinal FROM part)),
m AS (SELECT scheme_id, coalesce(pf, rf) AS field, arg_min(struct_pack(pf := pf, op := op, value := value, decision := decision), ordinal) AS f FROM fi GROUP BY 1, 2)
SELECT error_id, n, e.kind, CASE WHEN failed IS NULL THEN 'not_run' WHEN failed THEN 'judge_failed' WHEN f IS NULL THEN 'missed' WHEN f.decision <> 'auto_accept' THEN 'flagged' WHEN e.kind = 'dropped_predicate' AND f.pf = e.field AND f.op = e.op AND f.value = e.value THEN 'corrected' ELSE 'wrong_fix' END AS outcome, count(*) AS rows
FROM e LEFT JOIN res ON res.scheme_id = e.scheme_id LEFT JOIN m ON m.scheme_id = e.scheme_id AND m.field = e.field GROUP BY ALL""")
def error_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as injected errors, suppliers as judged schemes, parts as findings."""
    errors = read(spark, sf_dir, "lineitem").select(F.struct(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n")).alias("error_id"), F.col("l_suppkey").alias("scheme_id"), F.expr(_KIND).alias("kind"), F.concat(F.lit("f"), F.col("l_partkey") % 4).alias("field"), F.lit(">=").alias("op"), (F.col("l_quantity").cast("int") % 3).cast("long").alias("value"))
    results = read(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("scheme_id"), (F.col("s_suppkey") % 5 == 0).alias("failed"))
    n = F.col("p_partkey")
    field = F.concat(F.lit("f"), n % 4)
    findings = read(spark, sf_dir, "part").select((n % 50).alias("scheme_id"), n.alias("ordinal"), F.when(n % 3 != 0, field).alias("predicate_field"), F.when(n % 3 == 0, field).alias("retired_field"), F.when(n % 2 == 0, ">=").otherwise("<").alias("op"), (n % 3).cast("long").alias("value"), F.when(n % 5 < 2, "defer_to_review").otherwise("auto_accept").alias("decision"))
    found = reports.error_outcomes(errors, results, findings)
    return found.groupBy(F.col("error_id.id").alias("error_id"), F.col("error_id.n").alias("n"), "kind", "outcome").agg(F.count("*").alias("rows"))


@query("SELECT source AS \"group\", count(*) AS n, round(avg((doc_id % 4 = 0)::INT), 6) AS false_accept, round(avg((doc_id % 4 <> 0)::INT), 6) AS false_defer FROM documents GROUP BY source")
def clean_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("group"), (F.col("doc_id") % 4 == 0).alias("accepted"))
    return reports.clean_control(docs).select("group", "n", F.round("false_accept", 6).alias("false_accept"), F.round("false_defer", 6).alias("false_defer"))


@query(f"SELECT {_KIND} AS kind, count(*) AS removed, count(*) FILTER (WHERE l_discount * 10 >= 0.66) AS produced FROM lineitem GROUP BY 1")
def produced_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.produced_rules(read(spark, sf_dir, "lineitem").select(F.expr(_KIND).alias("kind"), (F.col("l_discount") * 10).alias("agreement")))


@query("""WITH r AS (SELECT o_orderkey AS k, o_totalprice AS a, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 0.5 ELSE o_totalprice END AS b, o_totalprice * 2 AS c FROM orders)
SELECT k, a AS recorded, CASE WHEN k % 9 <> 0 THEN b END AS reproduced, c AS corrected, k % 9 <> 0 AND abs(a - b) < 0.00005 AS reproduces, round(c - a, 6) AS change FROM r""")
def figures_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    again = orders.where("k % 9 <> 0").withColumn("v", F.when(F.col("k") % 4 == 0, F.col("v") + 0.5).otherwise(F.col("v")))
    return reports.compared(orders, again, orders.withColumn("v", F.col("v") * 2), ["k"], "v").withColumn("change", F.round("change", 6))


@query("""WITH a AS (SELECT c_custkey AS scheme_id, c_custkey % 3 <> 0 AS valid, CASE WHEN c_custkey % 3 = 0 THEN 'bad sample' END AS reason, c_nationkey AS figure FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey AS scheme_id, c_custkey % 4 <> 0 AS valid, CASE WHEN c_custkey % 4 = 0 THEN 'judge failed' END AS reason, c_nationkey + 1 AS figure FROM customer WHERE c_custkey % 7 <> 0)
SELECT coalesce(a.scheme_id, b.scheme_id) AS scheme_id, CASE WHEN a.valid AND b.valid THEN a.figure END AS first, CASE WHEN a.valid AND b.valid THEN b.figure END AS second,
CASE WHEN a.valid AND b.valid THEN NULL WHEN b.valid = FALSE THEN b.reason WHEN NOT coalesce(a.valid, FALSE) THEN coalesce(a.reason, 'no first run') ELSE 'second not run' END AS reason FROM a FULL JOIN b ON a.scheme_id = b.scheme_id""")
def paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as schemes, two configurations of each; those without a pair are listed with the reason."""
    c = read(spark, sf_dir, "customer")
    run = lambda drop, bad, why, plus: c.where(F.col("c_custkey") % drop != 0).select(F.col("c_custkey").alias("scheme_id"), (F.col("c_custkey") % bad != 0).alias("valid"), F.when(F.col("c_custkey") % bad == 0, why).alias("reason"), (F.col("c_nationkey") + plus).alias("figure"))
    rows, out = reports.paired_configurations(run(5, 3, "bad sample", 0), run(7, 4, "judge failed", 1))
    return rows.withColumn("reason", F.lit(None).cast("string")).unionByName(out, allowMissingColumns=True)


@query("""WITH c AS (SELECT o_orderpriority AS scheme_id, 'check' || o_custkey % 3 AS name, CASE o_orderkey % 2 WHEN 0 THEN 'before' ELSE 'after' END AS role, o_orderkey % 11 <> 0 AS ok, o_orderstatus AS value, 'F' AS expected FROM orders)
SELECT scheme_id, name, role, count(*) FILTER (WHERE ok AND value = expected) AS as_expected, count(*) FILTER (WHERE ok) AS valid_samples, count(*) FILTER (WHERE NOT ok) AS failed_samples, array_to_string(list_sort(list(DISTINCT value) FILTER (WHERE ok)), ',') AS values FROM c GROUP BY ALL""")
def amendment_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return reports.amendment_scorecard(o.select(F.col("o_orderpriority").alias("scheme_id"), F.concat(F.lit("check"), F.col("o_custkey") % 3).alias("name"), F.when(F.col("o_orderkey") % 2 == 0, "before").otherwise("after").alias("role"), (F.col("o_orderkey") % 11 != 0).alias("ok"), F.col("o_orderstatus").alias("value"), F.lit("F").alias("expected")))


@query("""WITH f AS (SELECT user_id AS scheme_id, 'arm' || event_id % 2 AS arm, event_id AS ordinal, event_id % 3 = 0 AS temporal, 'f' || event_id % 5 AS rf, CASE WHEN event_id % 4 = 0 THEN 'auto_accept' ELSE 'defer_to_review' END AS decision, 'f' || user_id % 5 AS target FROM events)
SELECT scheme_id, arm, count(*) AS findings, count(*) FILTER (WHERE temporal) AS temporal_findings, bool_or(temporal AND rf = target) AS found, arg_min(decision, ordinal) FILTER (WHERE temporal AND rf = target) AS gate_on_it FROM f GROUP BY ALL""")
def retrieval_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    n = F.col("event_id")
    findings = events.select(F.col("user_id").alias("scheme_id"), F.concat(F.lit("arm"), n % 2).alias("arm"), n.alias("ordinal"), F.when(n % 3 == 0, "temporal_supersession").otherwise("tone").alias("category"), F.concat(F.lit("f"), n % 5).alias("retired_field"), F.when(n % 4 == 0, "auto_accept").otherwise("defer_to_review").alias("decision"))
    return reports.retrieval_arms(findings, events.select(F.col("user_id").alias("scheme_id"), F.concat(F.lit("f"), F.col("user_id") % 5).alias("target")).distinct())


@query("""WITH o AS (SELECT 'c' || c_nationkey % 3 AS configuration, c_custkey AS scheme_id, c_custkey % 6 <> 0 AS valid, c_custkey % 10 / 10.0 AS agreement, c_custkey % 4 AS tp, c_custkey % 3 AS fp, c_custkey % 2 AS fn FROM customer),
s AS (SELECT configuration, scheme_id, sum(CASE WHEN valid THEN tp ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN valid THEN fp ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN valid THEN fn ELSE 0 END)::BIGINT AS fn, round(avg(CASE WHEN valid THEN agreement END), 6) AS agreement, count(*) AS runs, count(*) FILTER (WHERE valid) AS valid FROM o GROUP BY GROUPING SETS ((configuration, scheme_id), (configuration)))
SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) END AS f1 FROM s""")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    runs = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_nationkey") % 3).alias("configuration"), k.alias("scheme_id"), (k % 6 != 0).alias("valid"), ((k % 10) / 10.0).alias("agreement"), (k % 4).alias("tp"), (k % 3).alias("fp"), (k % 2).alias("fn"))
    out = reports.batch_report(runs.where("valid").select("configuration", "scheme_id", "tp", "fp", "fn"), runs.select("configuration", "scheme_id", "valid", "agreement"))
    return out.withColumn("agreement", F.round("agreement", 6)).withColumn("f1", F.round("f1", 6))


@query("""WITH a AS (SELECT event_type AS scheme_id, user_id AS profile_id, 'f' || event_id % 7 AS field FROM events WHERE event_id % 3 <> 0), t AS (SELECT event_type AS scheme_id, count(DISTINCT event_id % 7) AS fields FROM events GROUP BY 1),
p AS (SELECT scheme_id, profile_id, count(DISTINCT field) AS n FROM a GROUP BY ALL) SELECT p.scheme_id, count(*) AS verdicts, round(avg(n), 6) AS questions, fields, round(1 - avg(n) / fields, 6) AS saved FROM p JOIN t ON t.scheme_id = p.scheme_id GROUP BY p.scheme_id, fields""")
def questions_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("scheme_id"), F.col("user_id").alias("profile_id"), F.concat(F.lit("f"), F.col("event_id") % 7).alias("field"), "event_id")
    out = reports.questions_saved(events.where("event_id % 3 <> 0"), events)
    return out.withColumn("questions", F.round("questions", 6)).withColumn("saved", F.round("saved", 6))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return reports.first_wins(events.withColumn("o", F.col("event_id")), ["user_id", "event_type"], "o").select("user_id", "event_type", "event_id")


@query("SELECT s_suppkey AS slug, s_name AS name, 'verified' AS tier FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT p_partkey, p_name, 'catalogue' FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)")
def tiered_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = read(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("slug"), F.col("s_name").alias("name"))
    return reports.with_tier(gold, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("name")), ["slug", "name"])


@query("""WITH a AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE ' ' END AS v FROM supplier), b AS (SELECT n_nationkey AS k, n_name AS v FROM nation)
SELECT c_custkey, CASE WHEN trim(coalesce(a.v, '')) <> '' THEN a.v ELSE b.v END AS v, CASE WHEN trim(coalesce(a.v, '')) <> '' THEN 'record' WHEN b.v IS NOT NULL THEN 'document' ELSE 'none' END AS origin FROM customer LEFT JOIN a ON a.k = c_custkey % 60 LEFT JOIN b ON b.k = c_custkey % 60""")
def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value from the matched record, else from the document, else none."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 60).alias("k"))
    records = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(" ").alias("v"))
    return reports.enriched(rows, records, read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), "k", "v").select("c_custkey", "v", "origin")


_TEMPLATE, _RENDERED = _words("p_partkey", "Hi {name}", "Plain", "{a} and {b}"), _words("CAST(floor(p_partkey / 3) AS INT)", "Salut {name}", "Simple", "{b} et {a}", "")


@query(f"""WITH k AS (SELECT p_partkey AS key, {_TEMPLATE} AS source, {_RENDERED} AS t, p_partkey % 5 AS stale, p_partkey % 7 AS lost FROM part)
SELECT key, CASE WHEN lost <> 0 AND stale <> 0 AND t <> '' AND list_sort(list_distinct(regexp_extract_all(t, '\\{{[a-z_]*\\}}'))) = list_sort(list_distinct(regexp_extract_all(source, '\\{{[a-z_]*\\}}'))) THEN t ELSE source END AS text FROM k""")
def translated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.expr(_TEMPLATE).alias("source"), F.expr(_RENDERED).alias("text"))
    stored = p.where("key % 7 <> 0").withColumn("source", F.when(F.col("key") % 5 == 0, "old").otherwise(F.col("source"))).withColumn("lang", F.lit("fr"))
    return reports.translated(p.select("key", "source"), stored, "fr").select("key", "text")


@query("""WITH f AS (SELECT DISTINCT p_partkey % 60 AS f FROM part) SELECT f AS field, CASE WHEN f < 25 THEN f WHEN f < 50 THEN f - 25 END AS canonical, CASE WHEN f < 25 THEN 'canonical' WHEN f < 50 THEN 'alias' ELSE 'proposed' END AS found FROM f""")
def ontology_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' keys as canonical fields, those plus 25 as aliases."""
    fields = read(spark, sf_dir, "part").select((F.col("p_partkey") % 60).cast("long").alias("field")).distinct()
    n = F.col("n_nationkey").cast("long")
    return reports.ontology_coverage(fields, read(spark, sf_dir, "nation").select(n.alias("name"), F.array(n + 25).alias("aliases")))


@query("SELECT n_name AS field, n_nationkey % 2 = 0 AS family, CASE WHEN n_nationkey % 2 = 0 THEN CASE WHEN n_nationkey % 3 = 0 THEN 'Do they live in their ' || n_name || '?' ELSE 'What is their ' || replace(n_name, '_', ' ') || '?' END ELSE CASE WHEN n_nationkey % 3 = 0 THEN 'Do you live in your ' || n_name || '?' ELSE 'What is your ' || replace(n_name, '_', ' ') || '?' END END AS question FROM nation JOIN region ON n_regionkey = r_regionkey")
def question_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # region: 5 rows
    fields = nation.select(F.col("n_name").alias("field"), (F.col("n_nationkey") % 2 == 0).alias("family"))
    known = nation.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"), F.concat(F.lit("Do you live in your "), "n_name", F.lit("?")).alias("question"))
    return reports.question_text(fields, known)


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN doc_id % 9 = 0 THEN 0 WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END, doc_id)::INT AS place FROM documents")
def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("key"), (F.col("doc_id") % 9 == 0).alias("by_hand"), F.when(F.col("doc_id") % 2 == 0, "done").alias("text"))
    return reports.review_order(docs).select(F.col("key").alias("doc_id"), "lang", "place")


@query("SELECT page_id, length(trim(substring(html, strpos(html, '<article>'), strpos(html, '</article>') - strpos(html, '<article>')))) AS n FROM pages")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages from the start of the article to its end."""
    return read(spark, sf_dir, "pages").select("page_id", F.length(reports.between(F.col("html"), "<article>", "</article>")).cast("long").alias("n"))


@query("SELECT user_id, string_agg(event_id::VARCHAR, chr(10) || chr(10) ORDER BY ts, event_id::VARCHAR) AS text FROM events GROUP BY user_id")
def dated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dated_text(read(spark, sf_dir, "events").select("user_id", F.col("ts").alias("date"), F.col("event_id").cast("string").alias("text")), ["user_id"])


_CRITERION = {"kind": _words("l_linenumber", "required", "disqualifying", "required", "remark"), "field": "'f' || CAST(l_partkey % 9 AS INT)", "op": _words("(l_suppkey + l_linenumber)", ">=", "==", "in", "<", "!=", ">", "<=", "not_in", ">=", "==", "~"), "cat": _words("(l_suppkey + l_partkey)", "economic", "", "other")}


def _criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    return once.selectExpr("l_orderkey AS doc_id", "l_linenumber AS ordinal", "CAST(l_suppkey AS STRING) AS value_repr", *[f"{e} AS {n}" for n, e in _CRITERION.items()])


_CRITERIA = f"c AS (SELECT l_orderkey AS doc_id, l_linenumber AS ordinal, l_suppkey::VARCHAR AS value_repr, {', '.join(f'{e} AS {n}' for n, e in _CRITERION.items())} FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)), j AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'required') AS req, count(*) FILTER (WHERE kind <> 'remark' AND op = '~') AS bad FROM c GROUP BY 1)"


@query(f"""WITH {_CRITERIA} SELECT c.doc_id, CASE WHEN kind = 'required' THEN 'inclusion.and[' ELSE 'exclusions[' END || (row_number() OVER (PARTITION BY c.doc_id, kind ORDER BY ordinal) - 1) || ']' AS path, field, CASE WHEN cat = '' THEN 'other' ELSE cat END AS cat, op, value_repr, CASE WHEN kind = 'disqualifying' THEN 'self' END AS quantifier
FROM c JOIN j ON j.doc_id = c.doc_id WHERE kind <> 'remark' AND req > 0 AND bad = 0""")
def flat_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, their lines as extracted criteria."""
    return intake.flat_to_rules(_criteria(spark, sf_dir))[0].select("doc_id", "path", "field", "cat", "op", "value_repr", "quantifier")


@query(f"WITH {_CRITERIA} SELECT doc_id, CASE WHEN req = 0 THEN 'no required condition' ELSE 'schema validation failed' END AS reason FROM j WHERE req = 0 OR bad > 0")
def failed_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.flat_to_rules(_criteria(spark, sf_dir))[1]


@query("""WITH a AS (SELECT o_orderkey AS d, CASE WHEN o_orderkey % 6 = 0 THEN 'bad core' END AS r FROM orders WHERE o_orderkey % 4 <> 0), b AS (SELECT o_orderkey AS d, CASE WHEN o_orderkey % 5 = 0 THEN 'bad metadata' END AS r FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(a.d, b.d) AS doc_id, coalesce(a.r, CASE WHEN a.d IS NULL THEN 'core missing' END, b.r, CASE WHEN b.d IS NULL THEN 'metadata missing' END, 'merged') AS outcome FROM a FULL JOIN b ON a.d = b.d""")
def merged_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders")
    core = orders.where(k % 4 != 0).select(k.alias("doc_id"), F.col("o_totalprice").alias("price"), F.when(k % 6 == 0, "bad core").alias("reason"))
    meta = orders.where(k % 7 != 0).select(k.alias("doc_id"), F.col("o_orderstatus").alias("status"), F.when(k % 5 == 0, "bad metadata").alias("reason"))
    good, failed = intake.merge_extraction(core, meta)
    return good.select("doc_id", F.lit("merged").alias("outcome")).unionByName(failed.select("doc_id", F.col("reason").alias("outcome")))


@query("SELECT doc_id, sha256(text) AS source_sha256, 'r2' AS tag, 'local' AS provider FROM documents")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.stamp_provenance(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", tag="r2", provider="local").drop("text")


_DETAILS = [("json_validate_failed: 429", "truncated_completion_budget", False), ("Error 429: slow down", "rate_limited", True), ("Rate_Limit on tokens per day", "rate_limited", False), ("requests per minute", "rate_limited", True), ("boom", "api_error", False), ("", "api_error", False), ("Max completion tokens reached", "truncated_completion_budget", False)]


@query(f"SELECT event_id, CASE event_id % {len(_DETAILS)} {' '.join(f'WHEN {i} THEN {x[1]!r}' for i, x in enumerate(_DETAILS))} END AS reason, event_id % {len(_DETAILS)} IN ({', '.join(str(i) for i, x in enumerate(_DETAILS) if x[2])}) AS retryable FROM events")
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = F.expr(_words("event_id", *[x[0] for x in _DETAILS]))
    return read(spark, sf_dir, "events").select("event_id", intake.classify_failure(detail).alias("f")).select("event_id", "f.reason", "f.retryable")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'eligible' WHEN 1 THEN 'ineligible' END AS verdict, CASE WHEN doc_id % 5 < 2 THEN left(source || ' ' || lang, 500) END AS reason, CASE doc_id % 5 WHEN 2 THEN 'unrecognized verdict' WHEN 3 THEN 'unparseable response' WHEN 4 THEN 'unparseable response' END AS failure FROM documents""")
def direct_answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    k, why = F.col("doc_id") % 5, F.concat("source", F.lit(" "), "lang")
    said = lambda v: F.to_json(F.struct(F.lit(v).alias("verdict"), why.alias("reason")))
    content = F.when(k == 0, said(" Eligible ")).when(k == 1, said("ineligible")).when(k == 2, said("perhaps")).when(k == 3, F.lit("not json")).otherwise(F.lit(None))
    return intake.validate_direct_answers(docs.select("doc_id", content.alias("content"))).select("doc_id", "verdict", "reason", "failure")


@query("""SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN '{"a":' || turn || '}' WHEN 3 THEN '{"a":1}' ELSE '{}' END AS own, CASE (conv_id + turn) % 4 WHEN 0 THEN '[{"b":2}]' ELSE '[]' END AS family FROM conversations""")
def intake_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 4
    content = F.when(k == 0, F.concat(F.lit('{"self":{"a":'), "turn", F.lit('},"family_members":[{"b":2}]}'))).when(k == 1, '{"self":[1],"family_members":{"x":1}}').when(k == 2, "no json").otherwise('{"self":{"a":1}}')
    return intake.intake_shape(read(spark, sf_dir, "conversations").select("conv_id", "turn", content.alias("content")), "content").select("conv_id", "turn", "own", "family")


@query("""WITH f AS (SELECT doc_id, source AS scheme_id, n_chars % 3 AS run, text, doc_id % 5 = 0 AS wrong, (doc_id % 41) / 40.0 AS c FROM documents), l AS (SELECT scheme_id, max(run) AS run FROM f GROUP BY 1)
SELECT doc_id, CASE WHEN wrong OR c < 0.7 THEN 'deferred' ELSE 'accepted' END AS queue FROM f JOIN l ON l.scheme_id = f.scheme_id AND l.run = f.run""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of three runs of each source's findings, gated anew."""
    docs = read(spark, sf_dir, "documents")
    quote = F.when(F.col("doc_id") % 5 == 0, "no such words in any text").otherwise(F.col("text"))
    findings = docs.select("doc_id", F.col("source").alias("scheme_id"), (F.col("n_chars") % 3).alias("run"), F.lit("preambular_implied_fact").alias("category"), quote.alias("quote"), ((F.col("doc_id") % 41) / 40.0).alias("confidence"), F.col("text").alias("document"), of_num(F.lit(None)).alias("retired"), F.lit(None).cast("boolean").alias("consistent"))
    return gate.review_queue(findings).select("doc_id", "queue")


@query("""WITH p AS (SELECT user_id AS scheme_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pass, event_id % 4 AS findings, event_id % 3 AS applied FROM events),
e AS (SELECT *, coalesce(bool_or(findings = 0 OR applied = 0) OVER (PARTITION BY scheme_id ORDER BY pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS ended FROM p)
SELECT scheme_id, pass::INT AS pass, findings, applied, CASE WHEN findings = 0 THEN 'no findings' WHEN applied = 0 THEN 'none applied' WHEN pass = 2 THEN 'pass limit' END AS stop FROM e WHERE NOT ended AND pass <= 2""")
def repair_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    passes = read(spark, sf_dir, "events").select(F.col("user_id").alias("scheme_id"), place.alias("pass"), (F.col("event_id") % 4).alias("findings"), (F.col("event_id") % 3).alias("applied"))
    return gate.repair_passes(passes)


_CHANGED = """r AS (SELECT c_custkey AS scheme_id, 0 AS ordinal, CASE WHEN c_custkey % 2 = 0 THEN 'inclusion.and[0]' ELSE 'inclusion' END AS path, 'inclusion' AS location, 'age' AS field FROM customer UNION ALL SELECT c_custkey, 1, CASE WHEN c_custkey % 2 = 0 THEN 'inclusion.and[1]' ELSE 'exclusions[0]' END, CASE WHEN c_custkey % 2 = 0 THEN 'inclusion' ELSE 'exclusion' END, 'income' FROM customer),
f AS (SELECT c_custkey AS scheme_id, 0 AS ordinal, c_nationkey / 25.0 AS confidence, CASE c_nationkey % 3 WHEN 0 THEN 'add_predicate' WHEN 1 THEN 'add_exclusion' ELSE 'set_valid_from' END AS action, 'new' || c_nationkey AS field FROM customer)"""


@query(f"""WITH {_CHANGED}, n AS (SELECT * FROM f WHERE confidence >= 0.7 AND action <> 'set_valid_from')
SELECT r.scheme_id, r.ordinal, CASE WHEN r.path = 'inclusion' AND n.action = 'add_predicate' THEN 'inclusion.and[0]' ELSE r.path END AS path, r.location, r.field FROM r LEFT JOIN n ON n.scheme_id = r.scheme_id
UNION ALL SELECT scheme_id, 2, CASE WHEN action = 'add_predicate' THEN CASE WHEN scheme_id % 2 = 0 THEN 'inclusion.and[2]' ELSE 'inclusion.and[1]' END ELSE CASE WHEN scheme_id % 2 = 0 THEN 'exclusions[0]' ELSE 'exclusions[1]' END END, CASE WHEN action = 'add_predicate' THEN 'inclusion' ELSE 'exclusion' END, field FROM n""")
def applied_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rule sets of two predicates, with a finding each: paths move down where an inclusion becomes an AND."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    even = k % 2 == 0
    one = lambda n, path, place, field: c.select(k.alias("scheme_id"), F.lit(n).alias("ordinal"), path.alias("path"), place.alias("location"), F.lit(field).alias("field"), F.lit("==").alias("op"), F.lit("1").alias("value_repr"), F.lit(None).cast("string").alias("quantifier"))
    flat = one(0, F.when(even, "inclusion.and[0]").otherwise("inclusion"), F.lit("inclusion"), "age").unionByName(one(1, F.when(even, "inclusion.and[1]").otherwise("exclusions[0]"), F.when(even, "inclusion").otherwise("exclusion"), "income"))
    n = F.col("c_nationkey")
    findings = c.select(k.alias("scheme_id"), F.lit(0).alias("ordinal"), (n / 25.0).alias("confidence"), F.when(n % 3 == 0, "add_predicate").when(n % 3 == 1, "add_exclusion").otherwise("set_valid_from").alias("action"), F.concat(F.lit("new"), n).alias("field"), F.lit("==").alias("op"), F.lit("1").alias("value_repr"), F.lit(None).cast("string").alias("quantifier"))
    return gate.apply_findings(flat, findings)[0].select("scheme_id", "ordinal", "path", "location", "field")
