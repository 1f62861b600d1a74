"""Queries over flat rules that come from the tables, and over answers, changes and progress, with their SQL.

A customer is a predicate here, four of them a rule set. The expressions are written once, for Spark and for the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.catalog_base import query, read
from verdictlake.operators import confidence, gate, indexed, ledger, questions, reports, retrieval, rules, scoring
from verdictlake.plans import household as H
from verdictlake.plans import schema
from verdictlake.plans.rulesets import Exclusion, Leaf, Node, RuleSet


def _pick(number: str, *values: str) -> str:
    """SQL for one of several values by a number's remainder; NULL is written as such."""
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v == 'NULL' else repr(v)}" for i, v in enumerate(values)) + " END"


_RULE = {
    "scheme_id": "'s' || CAST(floor(c_custkey / 4) AS INT)",
    "ordinal": "CAST(c_custkey % 4 AS INT)",
    "location": _pick("(c_custkey + c_nationkey)", "inclusion", "inclusion", "inclusion", "exclusion", "exception"),
    "field": _pick("(c_custkey * 3 + c_nationkey)", "is_resident", "has_aadhaar", "age", "income", "caste", "is_indian_citizen"),
    "cat": _pick("(c_custkey * 5 + c_nationkey)", "economic", "demographic", "bogus", "other", "exception_to_exclusion"),
    "op": _pick("(c_custkey * 7 + c_nationkey)", "==", "!=", "<", ">=", "in", "~", ">"),
    "kind": _pick("(c_custkey * 11 + c_nationkey)", "num", "num", "bool", "str"),
    "num": "CAST(CAST(floor(c_acctbal / 1000) AS INT) AS DOUBLE)",
    "quantifier": _pick("(c_custkey + c_nationkey * 3)", "self", "some_family_member", "count_family_members", "NULL", "nobody"),
    "has_except": "(c_custkey + c_nationkey * 5) % 3 = 0",
    "except_scope": _pick("(c_custkey + c_nationkey * 2)", "NULL", "member", "applicant", "world"),
    "count_op": _pick("(c_custkey + c_nationkey * 7)", "<", ">=", "NULL"),
    "count": "CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey % 6 - 2 AS INT) END",
}
_RULES = f"r AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _RULE.items())} FROM customer)"


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in _RULE.items()])
    value = F.struct("kind", F.when(F.col("kind").isin("num", "bool"), F.when(F.col("kind") == "bool", F.col("num") % 2).otherwise(F.col("num"))).alias("num"), F.when(F.col("kind") == "str", F.concat(F.lit("v"), F.col("num").cast("int"))).alias("str"), F.lit(None).cast("array<string>").alias("arr"))
    return rows.withColumn("value", value).withColumn("path", F.concat("location", F.lit("["), "ordinal", F.lit("]"))).withColumn("value_repr", F.col("num").cast("int").cast("string"))


_FAULTS = lambda *checks: "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({ok}, TRUE) THEN '{name}' END" for ok, name in checks) + ")"


@query(f"""WITH {_RULES} SELECT scheme_id, ordinal, {_FAULTS(("cat IN ('citizenship', 'demographic', 'occupation', 'economic', 'political', 'professional', 'institutional', 'family_unit', 'temporal', 'cross_scheme', 'vacuous', 'other', 'exception_to_exclusion')", 'cat'), ("op IN ('==', '!=', '<', '<=', '>', '>=', 'in', 'not_in')", 'op'), ("quantifier IN ('self', 'some_family_member', 'all_family_members', 'count_family_members')", 'quantifier'), ("except_scope IN ('member', 'applicant')", 'except_scope'))} AS faults FROM r""")
def rule_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.validate_flat(_flat(spark, sf_dir)).select("scheme_id", "ordinal", F.array_join("faults", ",").alias("faults"))


@query(f"""WITH {_RULES} SELECT scheme_id, ordinal, {_FAULTS(("has_except OR coalesce(except_scope, 'member') = 'member'", 'scope without exception'), ("NOT (except_scope = 'applicant' AND quantifier = 'self')", 'applicant scope with self'), ("NOT (quantifier = 'count_family_members' AND has_except AND coalesce(except_scope, 'member') = 'member' AND count_op IN ('<', '<=', '=='))", 'member exception with a falling count'), ("(quantifier = 'count_family_members') = (count_op IS NOT NULL AND count IS NOT NULL)", 'count fields'), ("count >= 0", 'negative count'))} AS faults FROM r WHERE location = 'exclusion'""")
def exclusion_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.validate_exclusions(_flat(spark, sf_dir).where("location = 'exclusion'"))
    return found.select("scheme_id", "ordinal", F.array_join("faults", ",").alias("faults"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS valid_from, CAST(l_shipdate AS DATE) + (CAST(l_quantity AS INT) - 5) AS valid_to, l_tax * 20 - 0.2 AS confidence FROM lineitem)
SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN valid_to < valid_from THEN 'dates' END, CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence' END) AS faults FROM l WHERE valid_to < valid_from OR NOT confidence BETWEEN 0 AND 1""")
def date_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as dated rules, those with faults only."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("valid_from"), F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int") - 5).alias("valid_to"), (F.col("l_tax") * 20 - 0.2).alias("confidence"))
    return rules.split_valid(rules.validate_dates(rows))[1].select("l_orderkey", "l_linenumber", F.array_join("faults", ",").alias("faults"))


@query(f"WITH {_RULES} SELECT scheme_id, ordinal, CASE WHEN except_scope IS NOT NULL THEN 'member' END AS except_scope FROM r")
def member_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.force_member_scope(_flat(spark, sf_dir)).select("scheme_id", "ordinal", "except_scope")


@query(f"WITH {_RULES} SELECT scheme_id, count(*) FILTER (WHERE location = 'exclusion' OR (location = 'inclusion' AND field NOT IN ('is_resident', 'has_aadhaar', 'is_indian_citizen'))) = 0 AS vacuous FROM r GROUP BY scheme_id")
def vacuous_rule_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.is_vacuous(_flat(spark, sf_dir))


@query(f"""WITH {_RULES} SELECT DISTINCT scheme_id, field FROM r WHERE location = 'exclusion' AND quantifier <> 'self' EXCEPT
SELECT scheme_id, field FROM r WHERE location = 'inclusion' OR (location = 'exclusion' AND quantifier = 'self') OR except_scope = 'applicant'""")
def family_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.family_wide_fields(_flat(spark, sf_dir))


@query(f"WITH {_RULES} SELECT scheme_id, location, count(*) AS n FROM r GROUP BY ROLLUP (scheme_id, location)")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.predicates_per_scheme(_flat(spark, sf_dir))


@query(f"""WITH {_RULES}, t AS (SELECT scheme_id, field, list_sort(list(DISTINCT num)) AS t FROM r WHERE kind = 'num' GROUP BY ALL),
g AS (SELECT scheme_id, field, unnest(list_distinct(list_concat(t, [t[1] - 1, t[-1] + 1], list_transform(range(2, len(t) + 1), lambda i: (t[i] + t[i - 1]) / 2)))) AS v FROM t)
SELECT scheme_id, field, CASE WHEN v = floor(v) THEN v::INT || '.0' ELSE v::VARCHAR END AS value FROM g
UNION SELECT scheme_id, field, unnest(['true', 'false']) FROM r WHERE kind = 'bool'
UNION SELECT scheme_id, field, unnest(['v' || num::INT, '<none of these>']) FROM r WHERE kind = 'str'""")
def candidate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.candidate_values(_flat(spark, sf_dir))


@query(f"""WITH {_RULES}, a AS (SELECT scheme_id, ordinal, location || '[' || ordinal || ']' AS path, field || ' ' || op || ' ' || num::INT AS v FROM r WHERE ordinal <> 3 OR scheme_id LIKE '%1'),
b AS (SELECT scheme_id, ordinal, location || '[' || ordinal || ']' AS path, field || ' ' || op || ' ' || CASE WHEN num < 2 THEN num::INT + 1 ELSE num::INT END AS v FROM r WHERE ordinal <> 0 OR scheme_id LIKE '%2')
SELECT coalesce(a.scheme_id, b.scheme_id) AS scheme_id, coalesce(a.path, b.path) AS path, a.v AS old_value, b.v AS new_value FROM a FULL JOIN b ON a.scheme_id = b.scheme_id AND a.path = b.path WHERE a.v IS DISTINCT FROM b.v""")
def rule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two copies of the rules that differ in values, and in which rules they have."""
    flat = _flat(spark, sf_dir)
    new = flat.where("ordinal <> 0 OR scheme_id LIKE '%2'").withColumn("value_repr", F.when(F.col("num") < 2, F.col("num") + 1).otherwise(F.col("num")).cast("int").cast("string"))
    return rules.diff_rules(flat.where("ordinal <> 3 OR scheme_id LIKE '%1'"), new)


_DETECTORS = [{"name": "income_limit", "field": "income", "ops": ["<", ">="], "lo": 2, "hi": 8}, {"name": "age_rule", "field": "^age$", "location": "inclusion"}]


@query(f"""WITH {_RULES}, d AS (SELECT scheme_id, bool_or(field = 'income' AND op IN ('<', '>=') AND kind IN ('num', 'bool') AND CASE WHEN kind = 'bool' THEN num % 2 ELSE num END BETWEEN 2 AND 8) AS a, bool_or(field = 'age' AND location = 'inclusion') AS b FROM r GROUP BY scheme_id),
s AS (SELECT scheme_id, 'income_limit' AS name, coalesce(a, FALSE) AS seen FROM d UNION ALL SELECT scheme_id, 'age_rule', coalesce(b, FALSE) FROM d),
e AS (SELECT scheme_id, n.name, ordinal % 2 = 0 AS expected FROM (SELECT scheme_id, min(ordinal) + count(*) AS ordinal FROM r GROUP BY 1 UNION ALL SELECT 'nowhere', 1) x, (VALUES ('income_limit'), ('age_rule')) n(name))
SELECT e.scheme_id, e.name, expected, coalesce(seen, FALSE) AS seen, expected = coalesce(seen, FALSE) AS as_expected FROM e LEFT JOIN s ON s.scheme_id = e.scheme_id AND s.name = e.name""")
def detectors_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _flat(spark, sf_dir)
    schemes = flat.groupBy("scheme_id").agg((F.min("ordinal") + F.count("*")).alias("o")).unionByName(spark.range(1).select(F.lit("nowhere").alias("scheme_id"), F.lit(1).cast("long").alias("o")))
    expected = schemes.select("scheme_id", F.explode(F.array(*[F.lit(d["name"]) for d in _DETECTORS])).alias("name"), (F.col("o") % 2 == 0).alias("expected"))
    return rules.check_expected(rules.detect(flat, _DETECTORS), expected).select("scheme_id", "name", "expected", "seen", "as_expected")


# Drafts with repeated predicates: gold and draft are multisets of (field, op, value), several of them equal.
_MULTI = """g AS (SELECT n_name AS scheme_id, s_suppkey AS ordinal, 'inclusion' AS location, 'f' || s_suppkey % 3 AS field, CASE WHEN s_suppkey % 4 = 0 THEN 'economic' ELSE 'other' END AS cat, CAST(floor(s_acctbal / 4000) AS INT) AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 5 <> 0),
d AS (SELECT n_name AS scheme_id, s_suppkey AS ordinal, 'inclusion' AS location, 'f' || s_suppkey % 3 AS field, CASE WHEN s_suppkey % 6 = 0 THEN 'economic' ELSE 'other' END AS cat, CAST(floor(s_acctbal / 4000) AS INT) + CASE WHEN s_suppkey % 9 = 0 THEN 1 ELSE 0 END AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 7 <> 0),
gn AS (SELECT *, row_number() OVER (PARTITION BY scheme_id, field, v ORDER BY ordinal) AS rn FROM g), dn AS (SELECT *, row_number() OVER (PARTITION BY scheme_id, field, v ORDER BY ordinal) AS rn FROM d),
f AS (SELECT coalesce(gn.scheme_id, dn.scheme_id) AS scheme_id, coalesce(gn.field, dn.field) AS field, gn.ordinal AS go, dn.ordinal AS o, gn.cat AS gc, dn.cat AS dc FROM gn FULL JOIN dn ON gn.scheme_id = dn.scheme_id AND gn.field = dn.field AND gn.v = dn.v AND gn.rn = dn.rn),
gl AS (SELECT *, row_number() OVER (PARTITION BY scheme_id, field ORDER BY go) AS rn FROM f WHERE o IS NULL), dl AS (SELECT *, row_number() OVER (PARTITION BY scheme_id, field ORDER BY o) AS rn FROM f WHERE go IS NULL),
p AS (SELECT scheme_id, field, gc, dc, 'exact' AS label FROM f WHERE go IS NOT NULL AND o IS NOT NULL
  UNION ALL SELECT coalesce(gl.scheme_id, dl.scheme_id), coalesce(gl.field, dl.field), gl.gc, dl.dc, CASE WHEN dl.o IS NULL THEN 'missing' WHEN gl.go IS NULL THEN 'hallucinated' ELSE 'present_but_wrong' END FROM gl FULL JOIN dl ON gl.scheme_id = dl.scheme_id AND gl.field = dl.field AND gl.rn = dl.rn)"""


def _multi(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # nation: 25 rows
    none = F.lit(None).cast("string")

    def flat(keep: str, every: int, off: str) -> DataFrame:
        v = F.floor(F.col("s_acctbal") / 4000) + F.expr(f"CASE WHEN {off} THEN 1 ELSE 0 END")
        return rows.where(keep).select(F.col("n_name").alias("scheme_id"), F.col("s_suppkey").alias("ordinal"), F.lit("inclusion").alias("location"), F.concat(F.lit("f"), F.col("s_suppkey") % 3).alias("field"), F.when(F.col("s_suppkey") % every == 0, "economic").otherwise("other").alias("cat"), F.lit("==").alias("op"), v.cast("string").alias("value_repr"), none.alias("quantifier"), none.alias("parent_field"), none.alias("except_scope"))

    return flat("s_suppkey % 5 <> 0", 4, "false"), flat("s_suppkey % 7 <> 0", 6, "s_suppkey % 9 = 0")


@query(f"WITH {_MULTI} SELECT scheme_id, field AS about, label, count(*) AS n FROM p GROUP BY ALL")
def multiset_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal predicates several times over: pairs by label."""
    return scoring.paired(*_multi(spark, sf_dir)).groupBy("scheme_id", "about", "label").agg(F.count("*").alias("n"))


@query(f"WITH {_MULTI} SELECT scheme_id, field AS about, gc AS gold_cat, dc AS draft_cat, count(*) AS n FROM p WHERE gc <> dc GROUP BY ALL")
def category_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.category_disagreements(scoring.paired(*_multi(spark, sf_dir)))
    return found.groupBy("scheme_id", "about", "gold_cat", "draft_cat").agg(F.count("*").alias("n"))


@query(f"""WITH {_MULTI}, s AS (SELECT sum((label = 'exact')::INT)::BIGINT AS tp, sum((label IN ('present_but_wrong', 'hallucinated'))::INT)::BIGINT AS fp, sum((label IN ('present_but_wrong', 'missing'))::INT)::BIGINT AS fn FROM p), q AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM s)
SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, (SELECT round(avg((n_nationkey % 4 <> 0)::INT), 6) FROM nation) AS schema_validity FROM q""")
def batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = scoring.structural_score(scoring.paired(*_multi(spark, sf_dir)))
    validity = read(spark, sf_dir, "nation").select(F.col("n_name").alias("scheme_id"), (F.col("n_nationkey") % 4 != 0).alias("valid"))
    return scoring.batch_score(scores, validity).select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "schema_validity")])


@query(f"""WITH {_MULTI}, a AS (SELECT scheme_id, field, v FROM g), b AS (SELECT scheme_id, field, v FROM d)
SELECT scheme_id, field, v::VARCHAR AS value, change, count(*) AS n FROM (SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) GROUP BY ALL""")
def repeated_rules_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """multiset_diff of rule sets that hold equal predicates several times."""
    gold, draft = (t.select("scheme_id", "field", F.col("value_repr").alias("value")) for t in _multi(spark, sf_dir))
    return scoring.multiset_diff(gold, draft).groupBy("scheme_id", "field", "value", "change").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT o_orderpriority AS scheme_id, CASE o_orderkey % 3 WHEN 0 THEN 'eligible' WHEN 1 THEN 'ineligible' ELSE 'undetermined_missing_facts' END AS b, CASE WHEN o_custkey % 2 = 0 THEN 'undetermined_missing_facts' ELSE 'eligible' END AS e FROM orders)
SELECT scheme_id, count(*) AS n, round(avg((b = 'eligible')::INT), 6) AS said_eligible, round(avg((b = 'ineligible')::INT), 6) AS said_ineligible, round(avg((b = 'undetermined_missing_facts')::INT), 6) AS unsure FROM a WHERE e = 'undetermined_missing_facts' GROUP BY scheme_id""")
def silent_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    said = F.when(F.col("o_orderkey") % 3 == 0, "eligible").when(F.col("o_orderkey") % 3 == 1, "ineligible").otherwise("undetermined_missing_facts")
    rows = orders.select(F.col("o_orderpriority").alias("scheme_id"), said.alias("baseline_verdict"), F.when(F.col("o_custkey") % 2 == 0, "undetermined_missing_facts").otherwise("eligible").alias("evaluator_verdict"))
    return scoring.silent_defaults(rows).select("scheme_id", "n", *[F.round(c, 6).alias(c) for c in ("said_eligible", "said_ineligible", "unsure")])


@query("""WITH p AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS ga, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS da, o_orderpriority AS gb, CASE WHEN o_custkey % 5 = 0 THEN 'x' ELSE o_orderpriority END AS db FROM orders)
SELECT 'status' AS field, count(*) AS n, round(avg((ga IS NOT DISTINCT FROM da)::INT), 6) AS match_rate FROM p UNION ALL SELECT 'priority', count(*), round(avg((gb IS NOT DISTINCT FROM db)::INT), 6) FROM p""")
def scalar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    gold = orders.select(F.col("o_orderkey").alias("scheme_id"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"))
    draft = orders.select(F.col("o_orderkey").alias("scheme_id"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus")).alias("status"), F.when(F.col("o_custkey") % 5 == 0, "x").otherwise(F.col("o_orderpriority")).alias("priority"))
    return scoring.scalar_fields(gold, draft, ["status", "priority"]).withColumn("match_rate", F.round("match_rate", 6))


_FINDING = "CASE doc_id % 3 WHEN 0 THEN 'temporal_supersession' WHEN 1 THEN 'preambular_implied_fact' ELSE 'tone' END"


@query(f"""WITH f AS (SELECT doc_id, source AS scheme_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 10 <> 0 THEN 'supersedes:' || lang WHEN doc_id % 3 = 1 AND doc_id % 7 <> 0 THEN 'predicate:' || lang END AS key FROM documents),
s AS (SELECT DISTINCT source AS scheme_id, CASE WHEN doc_id % 3 = 0 THEN 'supersedes:' || lang END AS key FROM documents WHERE n_chars % 7 = 0 AND source < 'w')
SELECT doc_id, key, CASE WHEN key IS NOT NULL AND scheme_id IN (SELECT scheme_id FROM s) THEN EXISTS (SELECT 1 FROM s WHERE s.scheme_id = f.scheme_id AND s.key = f.key) END AS consistent FROM f""")
def reproduced_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    retired, implied = F.when(F.col("doc_id") % 10 != 0, F.col("lang")), F.when(F.col("doc_id") % 7 != 0, F.col("lang"))
    findings = docs.select("doc_id", F.col("source").alias("scheme_id"), gate.target_key(F.expr(_FINDING), retired, implied).alias("key"))
    sampled = docs.where("n_chars % 7 = 0 AND source < 'w'").select(F.col("source").alias("scheme_id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("supersedes:"), F.col("lang"))).alias("key"))
    return gate.reproduced(findings, sampled).select("doc_id", "key", "consistent")


@query("SELECT source AS \"group\", lang AS kind, CASE WHEN doc_id % 4 = 0 THEN 'accepted' ELSE 'deferred' END AS outcome, count(*) AS n FROM documents GROUP BY ALL")
def gate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return confidence.gate_outcomes(docs.select(F.col("source").alias("group"), F.col("lang").alias("kind"), F.when(F.col("doc_id") % 4 == 0, "accepted").otherwise("deferred").alias("outcome")))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) <= user_id % 3 AS is_error FROM events")
def error_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("scheme_id"), F.col("event_type").alias("key"), F.col("event_id").alias("ordinal"))
    return confidence.attribution(events, F.col("scheme_id") % 3).select(F.col("ordinal").alias("event_id"), "is_error")


@query(f"""WITH {_RULES}, c AS (SELECT scheme_id, ordinal, unnest(list_filter([CASE WHEN kind = 'num' AND op IN ('<', '<=', '>', '>=') THEN 'threshold' END, CASE WHEN op IN ('==', '!=', '<', '<=', '>', '>=') THEN 'operator' END, CASE WHEN kind = 'bool' THEN 'value' END, CASE WHEN has_except THEN 'exception_dropped' END, CASE WHEN location = 'exclusion' THEN 'exclusion_dropped' END, CASE WHEN location = 'inclusion' THEN 'predicate_dropped' END], lambda x: x IS NOT NULL)) AS kind FROM r) SELECT * FROM c""")
def mutation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.mutation_candidates(_flat(spark, sf_dir))


@query(f"""WITH {_RULES}, k AS (SELECT *, CASE WHEN ordinal = 0 AND kind = 'num' AND op IN ('<', '>', '>=') THEN 'threshold' WHEN ordinal = 0 AND op IN ('==', '!=', '<', '>', '>=') THEN 'operator' WHEN ordinal = 0 AND location = 'inclusion' THEN 'predicate_dropped' END AS k FROM r WHERE scheme_id IN (SELECT scheme_id FROM r WHERE ordinal = 0 AND (op IN ('==', '!=', '<', '>', '>=') OR location = 'inclusion')))
SELECT scheme_id, ordinal, CASE WHEN k = 'operator' THEN CASE op WHEN '==' THEN '!=' WHEN '!=' THEN '==' WHEN '<' THEN '>' WHEN '>' THEN '<' ELSE '<=' END ELSE op END AS op, CASE WHEN kind = 'str' THEN NULL WHEN k = 'threshold' THEN round_even(num * 1.5, 2) WHEN kind = 'bool' THEN num % 2 ELSE num END AS num FROM k WHERE k IS DISTINCT FROM 'predicate_dropped'""")
def mutated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule set with an error in its first predicate: a threshold, an operator, or the predicate gone."""
    flat = _flat(spark, sf_dir)
    first = flat.where("ordinal = 0").withColumn("error", F.when((F.col("kind") == "num") & F.col("op").isin("<", ">", ">="), "threshold").when(F.col("op").isin("==", "!=", "<", ">", ">="), "operator").when(F.col("location") == "inclusion", "predicate_dropped")).where("error IS NOT NULL")
    drawn = first.select("scheme_id", "ordinal", F.lit(0).alias("variant"), F.col("error").alias("kind"))
    return gate.mutate(flat.drop("kind"), drawn).select("scheme_id", "ordinal", "op", F.col("value.num").alias("num"))


@query(f"""WITH {_RULES}, a AS (SELECT scheme_id, max(ordinal) AS last FROM r GROUP BY 1), n AS (SELECT scheme_id, ordinal, field FROM r WHERE ordinal IN (1, 2) AND num > 3)
SELECT scheme_id, ordinal, field FROM r UNION ALL SELECT n.scheme_id, (last + row_number() OVER (PARTITION BY n.scheme_id ORDER BY n.ordinal))::INT, 'new_' || field FROM n JOIN a ON a.scheme_id = n.scheme_id""")
def accepted_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _flat(spark, sf_dir).select("scheme_id", "ordinal", "field", "num")
    decided = flat.select("scheme_id", "ordinal", F.when((F.col("num") > 3) & F.col("ordinal").isin(1, 2), "auto_accept").otherwise("defer_to_review").alias("decision"), F.struct(F.concat(F.lit("new_"), "field").alias("field"), "num").alias("predicate"))
    return gate.apply_accepted(flat, decided).select("scheme_id", "ordinal", "field")


@query("""WITH w AS (SELECT o_orderpriority AS item, o_orderkey AS k FROM orders), d AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT item, count(*) AS expected, count(n) AS done, count(*) FILTER (WHERE n > 1) AS retried, count(*) FILTER (WHERE n IS NULL) AS missing FROM w LEFT JOIN d ON w.k = d.k GROUP BY item""")
def work_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as work, their returned lines as results."""
    work = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("item"), F.col("o_orderkey").alias("k"))
    return ledger.progress(work, read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")), ["k"], "item")


_TRANSLATED = "t AS (SELECT doc_id AS key, lang, CASE doc_id % 3 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'machine' ELSE 'none' END AS status, n_chars AS source, CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS current_source FROM documents)"


def _translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr("doc_id AS key", "lang", "CASE doc_id % 3 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'machine' ELSE 'none' END AS status", "n_chars AS source", "CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS current_source")


@query(f"WITH {_TRANSLATED} SELECT lang, count(*) AS total, count(*) FILTER (WHERE status = 'reviewed') AS reviewed, count(*) FILTER (WHERE status = 'machine') AS machine, count(*) FILTER (WHERE source = current_source) AS current FROM t GROUP BY lang")
def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.review_status(_translations(spark, sf_dir))


@query(f"WITH {_TRANSLATED} SELECT c.key, CASE WHEN t.source IS NULL THEN 'missing' ELSE 'stale' END AS why FROM t c LEFT JOIN t ON t.key = c.key AND t.lang = 'fr' WHERE t.source IS NULL OR t.source <> c.current_source")
def translation_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _translations(spark, sf_dir)
    return ledger.translation_work(rows.select("key", F.col("current_source").alias("source")), rows, "fr")


@query("""WITH c AS (SELECT l_orderkey AS k, l_linenumber AS m, l_quantity AS q, l_tax AS x FROM lineitem), o AS (SELECT k, m, CASE WHEN k % 3 = 0 THEN q + 1 ELSE q END AS q, x FROM c WHERE k % 5 <> 0)
SELECT c.k, c.m, CASE WHEN o.k IS NULL THEN 'new' WHEN o.q = c.q AND o.x = c.x THEN 'reused' ELSE 'stale' END AS status FROM c LEFT JOIN o ON o.k = c.k AND o.m = c.m""")
def reused_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("m"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("x"))
    now = lines.select("k", "m", F.create_map(F.lit("q"), "q", F.lit("x"), "x").alias("facts"))
    changed = F.when(F.col("k") % 3 == 0, F.col("q") + 1).otherwise(F.col("q"))
    old = lines.where("k % 5 <> 0").select("k", "m", F.create_map(F.lit("x"), "x", F.lit("q"), changed).alias("facts"))  # order of facts is no difference
    return ledger.reuse_answers(old, now, ["k", "m"], "facts").select("k", "m", "status")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 1 ELSE 2 END, event_id DESC) AS n FROM events WHERE event_type <> (SELECT max(event_type) FROM events)) WHERE n = 1")
def preferred_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as stages: the first is best, the last none; the others rank below the first."""
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    low, high = events.agg(F.min("event_type"), F.max("event_type")).first()
    staged = events.where(F.col("event_type") != high).withColumn("stage", F.when(F.col("event_type") == low, "gated").otherwise("plain"))
    return ledger.prefer_stage(staged, ["user_id"], "stage", ["gated", "judged", "plain"], "event_id").select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to_derived FROM events")
def version_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("valid_from", F.struct("ts", "event_id"))
    return retrieval.with_intervals(events, "user_id").select("user_id", "event_id", F.col("valid_to_derived.ts").alias("valid_to_derived"))


@query("""WITH m AS (SELECT o_orderkey AS profile_id, l_linenumber * 1000000 + l_partkey AS ordinal, l_suppkey % 3 AS member, 'f' || l_partkey % 5 AS field, CASE l_quantity::INT % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS relevant FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
f(field, sensitive, screened_by) AS (VALUES ('f0', TRUE, 'screen0'), ('f1', TRUE, NULL), ('f2', FALSE, NULL)),
r AS (SELECT m.*, sensitive, screened_by, row_number() OVER (PARTITION BY profile_id ORDER BY relevant DESC NULLS LAST, coalesce(sensitive, FALSE), ordinal, member) AS n FROM m LEFT JOIN f ON m.field = f.field)
SELECT profile_id, member, coalesce(screened_by, field) AS ask, field FROM r WHERE n = 1""")
def next_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    left = F.col("l_quantity").cast("int") % 3
    missing = lines.select(F.col("o_orderkey").alias("profile_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ordinal"), (F.col("l_suppkey") % 3).alias("member"), F.concat(F.lit("f"), F.col("l_partkey") % 5).alias("field"), F.when(left == 0, True).when(left == 1, False).alias("relevant"))
    fields = spark.createDataFrame([("f0", True, "screen0"), ("f1", True, None), ("f2", False, None)], "field STRING, sensitive BOOLEAN, screened_by STRING")
    return questions.next_fact(missing, fields)


@query("""WITH f AS (SELECT l_orderkey AS profile_id, l_linenumber AS member_ix, 'screen' AS field, l_returnflag = 'R' AS v FROM lineitem WHERE l_suppkey % 4 <> 0 UNION ALL SELECT l_orderkey, l_linenumber, 'secret', TRUE FROM lineitem WHERE l_partkey % 5 = 0)
SELECT profile_id, member_ix, field, v FROM f UNION ALL SELECT DISTINCT profile_id, member_ix, 'secret', FALSE FROM f s WHERE field = 'screen' AND NOT v AND NOT EXISTS (SELECT 1 FROM f x WHERE x.profile_id = s.profile_id AND x.member_ix = s.member_ix AND x.field = 'secret')""")
def screened_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    value = lambda c: F.struct(F.lit("bool").alias("kind"), c.cast("int").cast("double").alias("num"), F.lit(None).cast("string").alias("str"), F.lit(None).cast("array<string>").alias("arr")).alias("value")
    row = lambda field, c: (F.col("l_orderkey").alias("profile_id"), F.col("l_linenumber").alias("member_ix"), F.lit(field).alias("field"), value(c))
    facts = lines.where("l_suppkey % 4 <> 0").select(*row("screen", F.col("l_returnflag") == "R")).unionByName(lines.where("l_partkey % 5 = 0").select(*row("secret", F.lit(True))))
    fields = spark.createDataFrame([("secret", "screen"), ("plain", None)], "field STRING, screened_by STRING")
    return questions.settle_screened(facts, fields).select("profile_id", "member_ix", "field", (F.col("value.num") == 1).alias("v"))


@query(f"""WITH {_RULES}, k AS (SELECT scheme_id, field, arg_min(kind, ordinal) AS kind, bool_or(coalesce(location = 'inclusion', FALSE) OR coalesce(quantifier = 'self', FALSE) OR coalesce(except_scope = 'applicant', FALSE)) AS own FROM r WHERE field NOT IN ('is_resident', 'age', 'income') GROUP BY ALL)
SELECT scheme_id, field, CASE kind WHEN 'bool' THEN 'boolean' WHEN 'num' THEN 'number' ELSE 'text' END AS answer_type, NOT own AS family FROM k""")
def novel_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    ontology = spark.createDataFrame([("is_resident",), ("age",)], "name STRING")
    return reports.novel_fields(_flat(spark, sf_dir), ontology, spark.createDataFrame([("income",)], "field STRING")).select("scheme_id", "field", "answer_type", "family")


@query("SELECT sha256(coalesce(text, '')) AS sha256, arg_min(source || '/' || doc_id, struct_pack(a := length(source || '/' || doc_id), b := source || '/' || doc_id)) AS path FROM documents GROUP BY 1")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, one kept for each content."""
    docs = read(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("path"), "text")
    return retrieval.content_dedup(docs).select("sha256", "path")


@query("""WITH m AS (SELECT l_orderkey AS k, count(*) FILTER (WHERE l_suppkey % 17 <> 0 AND l_quantity >= 45) AS low, count(*) FILTER (WHERE l_suppkey % 17 = 0) AS unknown FROM lineitem GROUP BY 1)
SELECT o_orderkey AS profile_id, o_orderkey % 2 = 0 AND (coalesce(low, 0) <= 1 AND coalesce(low, 0) + coalesce(unknown, 0) >= 1) AS relevant FROM orders LEFT JOIN m ON m.k = o_orderkey""")
def relevant_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an applicant's unknown quantity can change a verdict on orders that exclude two large lines or more.

    Every second order lacks the applicant's quantity; lines may lack theirs, three values each.
    """
    people = H.profiles(spark, sf_dir)
    lacks = F.transform("members", lambda m: F.when((m["ix"] == 0) & (F.col("profile_id") % 2 == 0), m.withField("facts", F.map_filter(m["facts"], lambda k, v: k != "quantity"))).otherwise(m))
    rules_ = RuleSet("q", Leaf("total_price", ">=", -1), (Exclusion("quantity", ">=", 45, quantifier="count_family_members", count_op=">=", count=2),))
    return questions.could_change(people.withColumn("members", lacks), rules_, "quantity")


#: A rule set for each part: a tree over the order, a count of its lines with a waiver, and returned lines with an exception.
_PART_RULES = [
    ("inclusion.and[0]", "inclusion", "total_price", ">=", "num", "p_retailprice * 40", None, None, None, None),
    ("inclusion.and[1].or[0]", "inclusion", "priority", "in", "list", "CASE p_partkey % 3 WHEN 0 THEN array('s:1-URGENT') WHEN 1 THEN array('s:1-URGENT', 's:2-HIGH') ELSE array('s:5-LOW') END", None, None, None, None),
    ("inclusion.and[1].or[1]", "inclusion", "status", "==", "str", "CASE WHEN p_partkey % 2 = 0 THEN 'F' ELSE 'O' END", None, None, None, None),
    ("exclusions[0]", "exclusion", "quantity", ">=", "num", "CAST(p_size AS DOUBLE)", "count_family_members", None, ">=", 3),
    ("exclusions[0].except", "exception", "total_price", ">=", "num", "300000D", None, "applicant", None, None),
    ("exclusions[1]", "exclusion", "returned", "==", "bool", "1D", "some_family_member", None, None, None),
    ("exclusions[1].except", "exception", "discount", ">=", "num", "CAST(p_size % 10 AS DOUBLE) / 100", None, "member", None, None),
]


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat rules of _PART_RULES for every part."""
    text = lambda x: "CAST(NULL AS STRING)" if x is None else f"'{x}'"
    rows = []
    for path, location, field, op, kind, value, quantifier, scope, count_op, count in _PART_RULES:
        num, string, arr = (value if kind in kinds else "NULL" for kinds in (("num", "bool"), ("str",), ("list",)))
        tagged = f"named_struct('kind', '{kind}', 'num', CAST({num} AS DOUBLE), 'str', CAST({string} AS STRING), 'arr', CAST({arr} AS ARRAY<STRING>))"
        rows.append(f"named_struct('path', '{path}', 'location', '{location}', 'field', '{field}', 'op', '{op}', 'value', {tagged}, 'quantifier', {text(quantifier)}, 'except_scope', {text(scope)}, 'count_op', {text(count_op)}, 'count', CAST({'NULL' if count is None else count} AS INT))")
    # dealt by rule set while it is one narrow row: a scan's few tasks would else build and sort all rules
    parts = read(spark, sf_dir, "part").selectExpr("'p' || p_partkey AS scheme_id", "p_partkey", "p_size", "p_retailprice").repartition(4 * spark.sparkContext.defaultParallelism, "scheme_id")
    return parts.selectExpr("scheme_id", f"explode(array({', '.join(rows)})) AS r").select("scheme_id", "r.*")


@query("""WITH r AS (SELECT 'p' || p_partkey AS scheme_id, p_retailprice * 40 AS least, p_partkey % 3 AS which, CASE WHEN p_partkey % 2 = 0 THEN 'F' ELSE 'O' END AS status, p_size AS size, p_size % 10 AS d FROM part),
c AS (SELECT l_orderkey AS k, size, count(*) FILTER (WHERE l_suppkey % 17 <> 0 AND l_quantity >= size) AS low, count(*) FILTER (WHERE l_suppkey % 17 = 0) AS unknown FROM lineitem, (SELECT DISTINCT size FROM r) GROUP BY ALL),
x AS (SELECT l_orderkey AS k, d, count(*) FILTER (WHERE l_partkey % 13 <> 0 AND l_returnflag = 'R' AND l_discount < d::DOUBLE / 100) AS hit, count(*) FILTER (WHERE l_partkey % 13 = 0 AND l_discount < d::DOUBLE / 100) AS unknown FROM lineitem, (SELECT DISTINCT d FROM r) GROUP BY ALL),
p AS (SELECT scheme_id, o_totalprice >= least AND (CASE WHEN o_orderkey % 7 <> 0 THEN CASE which WHEN 0 THEN o_orderpriority = '1-URGENT' WHEN 1 THEN o_orderpriority IN ('1-URGENT', '2-HIGH') ELSE o_orderpriority = '5-LOW' END END OR o_orderstatus = r.status) AS inc,
  (CASE WHEN coalesce(c.low, 0) >= 3 THEN TRUE WHEN coalesce(c.low, 0) + coalesce(c.unknown, 0) < 3 THEN FALSE END AND NOT o_totalprice >= 300000) OR CASE WHEN coalesce(x.hit, 0) > 0 THEN TRUE WHEN coalesce(x.unknown, 0) > 0 THEN NULL ELSE FALSE END AS exc
  FROM orders CROSS JOIN r LEFT JOIN c ON c.k = o_orderkey AND c.size = r.size LEFT JOIN x ON x.k = o_orderkey AND x.d = r.d)
SELECT scheme_id, count(*) FILTER (WHERE inc AND NOT exc) AS eligible, count(*) FILTER (WHERE NOT inc OR exc) AS ineligible, count(*) FILTER (WHERE (inc AND NOT exc) IS NULL) AS undetermined FROM p GROUP BY 1""")
def eval_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders each part's rule set makes eligible: as many rule sets as parts, all orders."""
    return indexed.tallies(H.profiles(spark, sf_dir), part_rules(spark, sf_dir))


@query("""WITH v AS (SELECT l_suppkey AS k, l_shipdate AS d, arg_max(l_extendedprice, struct_pack(a := l_orderkey, b := l_linenumber, c := l_extendedprice)) AS price FROM lineitem GROUP BY ALL), r AS (SELECT o_orderkey, o_custkey % 100 AS k, o_orderdate AS d FROM orders)
SELECT r.o_orderkey, v.d AS valid_from, v.price FROM r ASOF LEFT JOIN v ON r.k = v.k AND r.d >= v.d""")
def asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the latest line of a supplier that was shipped up to its own date."""
    versions = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("valid_from"), F.col("l_extendedprice").alias("price"), "l_orderkey", "l_linenumber")
    asked = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("k"), "o_orderdate")
    return retrieval.asof_join(asked, versions, "k", "o_orderdate", "valid_from", ["l_orderkey", "l_linenumber", "price"]).select("o_orderkey", "version.valid_from", "version.price")


@query("""WITH c AS (SELECT o_totalprice >= 50000 AS rich, o_orderstatus = 'F' AS f FROM orders),
a AS (SELECT FALSE AS relevance, CASE WHEN rich AND f THEN 'eligible' ELSE 'ineligible' END AS verdict, CASE WHEN NOT rich THEN 1 WHEN f THEN 4 ELSE 3 END AS n FROM c UNION ALL SELECT TRUE, CASE WHEN rich AND f THEN 'eligible' ELSE 'ineligible' END, CASE WHEN NOT rich THEN 1 ELSE 3 END FROM c)
SELECT relevance, verdict, count(*) AS chats, sum(n) AS questions FROM a GROUP BY ALL""")
def chat_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of simulated chats with all orders, with and without asking first what can change the verdict: one branch of the rules never holds."""
    never = Node("and", (Leaf("quantity", ">=", 10), Leaf("quantity", "<", 5)))
    rules_ = RuleSet("c", Node("and", (Leaf("total_price", ">=", 50000), Node("or", (never, Leaf("status", "==", "F"))))), (Exclusion("returned", "==", True, exception=Leaf("discount", ">=", 0.09)),))
    both = questions.compared_chats(H.profiles(spark, sf_dir), rules_)
    return both.groupBy("relevance", "verdict").agg(F.count("*").alias("chats"), F.sum(F.size("asked")).cast("long").alias("questions"))


@query("""WITH s AS (SELECT 's' || l_suppkey % 40 AS scheme_id, l_linenumber % 3 AS sample, 'f' || l_partkey % 6 AS field, l_returnflag AS op FROM lineitem WHERE l_orderkey % 5 = 0), g AS (SELECT 's' || o_custkey % 40 AS scheme_id, 'f' || o_orderkey % 6 AS field, CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'N' ELSE 'A' END AS op, count(*) AS n FROM orders WHERE o_orderkey % 16 = 0 GROUP BY ALL),
c AS (SELECT scheme_id, sample, field, op, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT scheme_id, count(DISTINCT sample) AS k FROM s GROUP BY 1 HAVING count(DISTINCT sample) >= 2),
a AS (SELECT c.scheme_id, c.n, least(c.n, coalesce(g.n, 0)) AS correct, count(*) OVER (PARTITION BY c.scheme_id, c.field, c.op) / k AS agreement FROM c JOIN k ON k.scheme_id = c.scheme_id LEFT JOIN g ON g.scheme_id = c.scheme_id AND g.field = c.field AND g.op = c.op)
SELECT scheme_id, sum(n)::BIGINT AS predicates, round(sum(n * agreement) / sum(n), 6) AS mean_agreement, round(sum(n) FILTER (WHERE agreement = 1) / sum(n), 6) AS unanimous, round(sum(correct) / sum(n), 6) AS precision FROM a GROUP BY 1""")
def agreement_with_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as predicates of three samples by supplier group, repeated ones counted, against orders as gold."""
    lines = read(spark, sf_dir, "lineitem").where("l_orderkey % 5 = 0").selectExpr("'s' || l_suppkey % 40 AS scheme_id", "l_linenumber % 3 AS sample", "'f' || l_partkey % 6 AS field", "l_returnflag AS op")
    gold = read(spark, sf_dir, "orders").where("o_orderkey % 16 = 0").selectExpr("'s' || o_custkey % 40 AS scheme_id", "'f' || o_orderkey % 6 AS field", "CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'N' ELSE 'A' END AS op")
    found = confidence.multiset_summary(confidence.multiset_agreement(lines, gold, ["field", "op"]))
    return found.withColumns({c: F.round(c, 6) for c in ("mean_agreement", "unanimous", "precision")})


_NAMES = "names(old, new) AS (VALUES ('N', 'n1'), ('n1', 'n2'), ('n2', 'none'), ('R', 'returned'), ('A', 'accepted'), ('accepted', 'A2'))"


@query(f"""WITH RECURSIVE {_NAMES}, walk AS (SELECT old, new FROM names UNION ALL SELECT w.old, n.new FROM walk w JOIN names n ON w.new = n.old), final AS (SELECT old, new FROM walk WHERE new NOT IN (SELECT old FROM names)),
f AS (SELECT l_orderkey AS id, l_returnflag AS field, sum(l_linenumber)::BIGINT AS v FROM lineitem GROUP BY ALL), was AS (SELECT id, new AS field, v FROM f JOIN final ON field = old WHERE id % 4 <> 0),
now AS (SELECT id, new AS field, CASE WHEN id % 3 = 0 THEN v ELSE v + v % 2 END AS v FROM f JOIN final ON field = old WHERE id % 7 <> 0 OR field <> 'N')
SELECT n.id, CASE WHEN n.id % 4 = 0 THEN 'new' WHEN bool_and(n.v IS NOT DISTINCT FROM w.v) AND count(*) = (SELECT count(*) FROM was x WHERE x.id = n.id) THEN 'reused' ELSE 'stale' END AS status, coalesce(string_agg(n.field, ',' ORDER BY n.field) FILTER (WHERE n.id % 4 = 0 OR n.v IS DISTINCT FROM w.v), '') AS to_ask FROM now n LEFT JOIN was w ON w.id = n.id AND w.field = n.field GROUP BY n.id""")
def reused_after_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' sums by return flag as stored facts under old names, against those of today under new ones."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("field"), "l_linenumber")
    facts = lines.repartition("id").groupBy("id", "field").agg(F.sum("l_linenumber").alias("v"))  # dealt first: a scan's task would else hold all its orders at once
    gathered = lambda df: df.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "v"))).alias("facts"))
    renames = spark.createDataFrame([("N", "n1"), ("n1", "n2"), ("n2", "none"), ("R", "returned"), ("A", "accepted"), ("accepted", "A2")], "old STRING, new STRING")
    final = F.create_map(*[F.lit(x) for pair in (("N", "none"), ("R", "returned"), ("A", "A2")) for x in pair])
    now = facts.where("id % 7 <> 0 OR field <> 'N'").select("id", final[F.col("field")].alias("field"), F.expr("CASE WHEN id % 3 = 0 THEN v ELSE v + v % 2 END").alias("v"))
    found = ledger.reuse_renamed(gathered(facts.where("id % 4 <> 0")), gathered(now), ["id"], "facts", renames)
    return found.withColumn("to_ask", F.array_join("to_ask", ","))


_HISTORY = """h AS (SELECT user_id AS scheme_id, 'v' || event_id AS version, ts AS valid_from, CASE WHEN event_id % 9 = 0 THEN ts + INTERVAL 1 HOUR END AS valid_to FROM events WHERE event_type = 'click' OR event_id % 50 = 0),
f AS (SELECT user_id AS scheme_id, event_id AS ordinal, value / 100 AS confidence, CASE WHEN event_id % 3 = 0 THEN 'temporal_supersession' ELSE 'tone' END AS category, 'v' || (event_id - event_id % 50) AS rule_version, CASE WHEN event_id % 6 = 0 THEN 'age' END AS retired_field, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 30 DAY END AS new_valid_from FROM events WHERE event_type <> 'click')"""


@query(f"""WITH {_HISTORY}, latest AS (SELECT scheme_id, max(struct_pack(a := valid_from, b := version)) AS l FROM h GROUP BY 1),
hit AS (SELECT f.scheme_id, l.b AS version, arg_max(struct_pack(r := rule_version, x := retired_field, d := new_valid_from), ordinal) AS f FROM f JOIN latest ON latest.scheme_id = f.scheme_id WHERE confidence >= 0.7 AND category = 'temporal_supersession' AND retired_field IS NOT NULL GROUP BY ALL),
n AS (SELECT h.scheme_id, h.version, coalesce(f.d, valid_from) AS valid_from, valid_to, f.r AS supersedes_version, f.x AS retired_field FROM h LEFT JOIN hit ON hit.scheme_id = h.scheme_id AND hit.version = h.version)
SELECT scheme_id, version, valid_from, least(valid_to, lead(valid_from) OVER (PARTITION BY scheme_id ORDER BY valid_from, version)) AS valid_to, supersedes_version, retired_field FROM n""")
def superseded_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' clicks as versions of their rules, other events as findings about the latest of them."""
    return gate.apply_temporal(*_temporal(spark, sf_dir))[0].drop("quote")


def _temporal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = read(spark, sf_dir, "events")
    history = events.where("event_type = 'click' OR event_id % 50 = 0").selectExpr("user_id AS scheme_id", "'v' || event_id AS version", "ts AS valid_from", "CASE WHEN event_id % 9 = 0 THEN ts + INTERVAL 1 HOUR END AS valid_to", "CAST(NULL AS STRING) AS supersedes_version", "CAST(NULL AS STRING) AS retired_field", "CAST(NULL AS STRING) AS quote")
    findings = events.where("event_type <> 'click'").selectExpr("user_id AS scheme_id", "event_id AS ordinal", "value / 100 AS confidence", "CASE WHEN event_id % 3 = 0 THEN 'temporal_supersession' ELSE 'tone' END AS category", "'v' || (event_id - event_id % 50) AS rule_version", "CASE WHEN event_id % 6 = 0 THEN 'age' END AS retired_field", "CASE WHEN event_id % 5 = 0 THEN props ELSE 'a quote that nobody wrote' END AS quote", "CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 30 DAY END AS new_valid_from")
    return history, findings


@query(f"""WITH {_HISTORY}, latest AS (SELECT scheme_id, max(struct_pack(a := valid_from, b := version)) AS l FROM h GROUP BY 1), doc AS (SELECT user_id AS scheme_id, string_agg(props, ' ') AS document FROM events GROUP BY 1),
hit AS (SELECT f.scheme_id, l.b AS version, l.a AS since, arg_max(struct_pack(r := rule_version, d := new_valid_from, o := ordinal), ordinal) AS f FROM f JOIN latest ON latest.scheme_id = f.scheme_id WHERE confidence >= 0.7 AND category = 'temporal_supersession' AND retired_field IS NOT NULL GROUP BY ALL)
SELECT hit.scheme_id, hit.version, concat_ws(',', CASE WHEN o.version IS NULL THEN 'unknown' END, CASE WHEN o.version IS NOT NULL AND NOT (CASE WHEN o.version = hit.version THEN coalesce(f.d, since) ELSE o.valid_from END < coalesce(f.d, since)) THEN 'order' END, CASE WHEN f.o % 5 <> 0 THEN 'fabricated' END) AS faults FROM hit LEFT JOIN h o ON o.scheme_id = hit.scheme_id AND o.version = f.r""")
def chain_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of superseded_versions against the versions there are and the users' own texts."""
    texts = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("scheme_id")).agg(F.array_join(F.collect_list("props"), " ").alias("document"))
    found = gate.chain_faults(gate.apply_temporal(*_temporal(spark, sf_dir))[0], texts)
    return found.withColumn("faults", F.array_join("faults", ","))


def _rule_texts() -> str:
    """SQL for a customer's rule set as JSON, with faults by remainders of its key."""
    when = lambda n, text: f"CASE WHEN c_custkey % {n} = 0 THEN '{text}' ELSE '' END"
    op = "CASE WHEN c_custkey % 7 = 0 THEN '~' ELSE '>=' END"
    count = """CASE WHEN c_custkey % 6 = 0 THEN '"2"' ELSE '2' END"""
    value = f"""CASE WHEN c_custkey % 11 = 0 THEN '' ELSE '"value": ' || c_nationkey || ', ' END"""
    tree = f"""'{{"and": [{{"field": "age", "op": "' || {op} || '", ' || {value} || '"cat": "economic"}}, {{"or": [{{"field": "caste", "op": "in", "value": ["a"], "cat": "other"' || {when(5, ', "colour": {"a": [1]}')} || '}}]' || {when(10, ', "and": []')} || '}}]}}'"""
    return f"""'{{"scheme_id": "s' || c_custkey || '", "inclusion": ' || {tree} || ', "exclusions": [{{"field": "x", "op": "==", "value": true, "cat": "other", "quantifier": "count_family_members", "count_op": ">=", "count": ' || {count} || '}}]' || CASE WHEN c_custkey % 13 = 0 THEN '' ELSE '}}' END"""


@query("""WITH c AS (SELECT 's' || c_custkey AS scheme_id, c_custkey AS k FROM customer)
SELECT scheme_id, '' AS path, 'not JSON' AS fault FROM c WHERE k % 13 = 0 UNION ALL
SELECT scheme_id, 'inclusion.and[0].op', 'unknown value' FROM c WHERE k % 13 <> 0 AND k % 7 = 0 UNION ALL
SELECT scheme_id, 'inclusion.and[0].value', 'missing key' FROM c WHERE k % 13 <> 0 AND k % 11 = 0 UNION ALL
SELECT scheme_id, 'inclusion.and[1].or[0].colour', 'unknown key' FROM c WHERE k % 13 <> 0 AND k % 5 = 0 AND k % 10 <> 0 UNION ALL
SELECT scheme_id, 'inclusion.and[1].or', 'unknown key' FROM c WHERE k % 13 <> 0 AND k % 10 = 0 UNION ALL
SELECT scheme_id, 'exclusions[0].count', 'wrong type' FROM c WHERE k % 13 <> 0 AND k % 6 = 0""")
def schema_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule set as JSON for each customer, many of them with a fault: keys that are unknown or missing, wrong types and values, broken texts."""
    rows = read(spark, sf_dir, "customer").selectExpr("'s' || c_custkey AS scheme_id", f"{_rule_texts()} AS rules")
    return schema.schema_faults(rows)


@query("""WITH k(ordinal, kind, kix) AS (VALUES (0, 'threshold', 0), (0, 'operator', 1), (0, 'predicate_dropped', 5), (1, 'predicate_dropped', 5), (2, 'operator', 1), (2, 'predicate_dropped', 5), (3, 'threshold', 0), (3, 'operator', 1), (3, 'exception_dropped', 3), (3, 'exclusion_dropped', 4), (4, 'threshold', 0), (4, 'operator', 1), (5, 'operator', 1), (5, 'value', 2), (5, 'exception_dropped', 3), (5, 'exclusion_dropped', 4), (6, 'threshold', 0), (6, 'operator', 1)),
c AS (SELECT 'p' || p_partkey AS scheme_id, k.*, md5('1:p' || p_partkey || ':' || ordinal || ':' || kind) AS h, md5('1:p' || p_partkey) AS s FROM part, k),
o AS (SELECT *, row_number() OVER (PARTITION BY scheme_id, ordinal ORDER BY h) AS r FROM c), t AS (SELECT *, row_number() OVER (PARTITION BY scheme_id, kind ORDER BY h) AS t FROM o WHERE r = 1),
u AS (SELECT *, row_number() OVER (PARTITION BY scheme_id ORDER BY t, (kix + instr('0123456789abcdef', substr(s, 1, 1))) % 6, h) - 1 AS turn FROM t),
n AS (SELECT *, row_number() OVER (ORDER BY turn, s, scheme_id) AS n FROM u)
SELECT scheme_id, ordinal, kind, turn, turn // 2 AS variant, turn % 2 AS place FROM n WHERE n <= (SELECT count(*) * 5 // 2 FROM part)""")
def injected_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors for the parts' rule sets, five for every two, two to a variant."""
    place = F.array_position(F.lit([x[0] for x in _PART_RULES]), F.col("path")) - 1
    flat = part_rules(spark, sf_dir).withColumn("ordinal", place.cast("int")).withColumn("has_except", F.col("location") == "exclusion")
    return gate.valid_errors(flat, read(spark, sf_dir, "part").count() * 5 // 2, 2)
