"""Rule evaluation as joins, for many rule sets or rules that arrive as data.

facts (profile_id, member_ix, field, value) and flat rules with exclusions' place; the same verdicts as compiled rules.
Rows of profile x leaf come from an equi-join on the field, so a profile meets only rules that read one of its facts.
A few rules are read from their table and compiled, so that a household is folded in its own row.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from verdictlake.functions import kleene
from verdictlake.functions.values import coded
from verdictlake.operators.evaluate import outcomes, prepared, verdict
from verdictlake.plans.rulesets import COUNT_OPERATORS, OPERATORS, QUANTIFIERS, SCOPES, Exclusion, Leaf, Node, RuleSet, leaves


def compare_columns(op: Column, a: Column, e: Column) -> Column:
    """compare() with the expected value as a column."""
    numeric = a["kind"].isin("bool", "num") & e["kind"].isin("bool", "num")
    same = F.when(numeric, a["num"] == e["num"]).when((a["kind"] == "str") & (e["kind"] == "str"), a["str"] == e["str"]).when((a["kind"] == "list") & (e["kind"] == "list"), a["arr"] == e["arr"]).otherwise((a["kind"] == "null") & (e["kind"] == "null"))
    found = F.when(e["kind"] == "list", F.array_contains(e["arr"], coded(a))).when((e["kind"] == "str") & (a["kind"] == "str"), F.contains(e["str"], a["str"]))
    less, more = (F.when(numeric, x["num"] < y["num"]).when((a["kind"] == "str") & (e["kind"] == "str"), x["str"] < y["str"]) for x, y in ((a, e), (e, a)))
    return F.when(op == "==", same).when(op == "!=", ~same).when(op == "in", found).when(op == "not_in", ~found).when(op == "<", less).when(op == "<=", ~more).when(op == ">", more).when(op == ">=", ~less)


def facts_of(profiles: DataFrame) -> DataFrame:
    """Long facts of profiles: profile_id, member_ix (0 for the applicant, others numbered by place), field, value."""
    one = profiles.select("profile_id", F.posexplode("members").alias("p", "m"))
    return one.select("profile_id", F.when(F.col("m.ix") == 0, 0).otherwise(F.col("p") + 1).alias("member_ix"), F.explode("m.facts").alias("field", "value"))


def leaf_results(facts: DataFrame, flat: DataFrame) -> DataFrame:
    """profile_id, member_ix, scheme_id, path, result for each present fact and leaf that reads it.

    Inclusion leaves and applicant-scoped exceptions are read from the applicant only. Absent facts give no row.
    """
    own = (F.col("location") == "inclusion") | (F.col("quantifier") == "self") | (F.col("except_scope") == "applicant")
    joined = facts.join(flat.select("scheme_id", "path", "location", "field", "op", F.col("value").alias("expected"), "quantifier", "except_scope"), "field")
    joined = joined.where(~F.coalesce(own, F.lit(False)) | (F.col("member_ix") == 0))
    return joined.select("profile_id", "member_ix", "scheme_id", "path", compare_columns(F.col("op"), F.col("value"), F.col("expected")).alias("result"))


def exclusion_counts(profiles: DataFrame, facts: DataFrame, flat: DataFrame) -> DataFrame:
    """profile_id, scheme_id, path of each exclusion with counts of members for whom it is true, false and unknown.

    A member-scoped exception of the same member is taken off; members without the fact are unknown. Profiles without
    any fact of an exclusion give no row: all their members are unknown.
    """
    results = leaf_results(facts, flat.where("location <> 'inclusion'")).withColumn("base", F.regexp_replace("path", r"\.except$", ""))
    hit = F.max(F.when(F.col("path") == F.col("base"), F.col("result")))
    exempt = F.max(F.when(F.col("path") != F.col("base"), F.col("result")))
    member_scoped = flat.where("location = 'exception' AND except_scope = 'member'").select("scheme_id", F.regexp_replace("path", r"\.except$", "").alias("base"), F.lit(True).alias("has"))
    per = results.groupBy("profile_id", "member_ix", "scheme_id", "base").agg(hit.alias("h"), exempt.alias("x")).join(member_scoped, ["scheme_id", "base"], "left")
    per = per.withColumn("r", F.when(F.coalesce("has", F.lit(False)), F.col("h") & ~F.col("x")).otherwise(F.col("h")))
    family = profiles.select("profile_id", F.size("members").alias("members"))
    counted = per.groupBy("profile_id", "scheme_id", "base").agg(F.count_if(F.col("r") == F.lit(True)).alias("true"), F.count_if(F.col("r") == F.lit(False)).alias("false")).join(family, "profile_id")
    rule = flat.where("location = 'exclusion'").select("scheme_id", F.col("path").alias("base"), "quantifier")
    total = F.when(F.col("quantifier") == "self", 1).otherwise(F.col("members"))
    return counted.join(rule, ["scheme_id", "base"]).select("profile_id", "scheme_id", F.col("base").alias("path"), "true", "false", (total - F.col("true") - F.col("false")).alias("unknown"))


def from_counts_by(kind: Column, true: Column, false: Column, unknown: Column) -> Column:
    """kleene.from_counts with the kind of node as a column."""
    return F.when(kind == "and", kleene.from_counts("and", true, false, unknown)).otherwise(kleene.from_counts("or", true, false, unknown))


#: Rules up to which they are compiled, levels of their trees up to which they are, and rules up to which their table is broadcast.
COMPILED, DEEP, SENT = 100, 20, 100_000
#: The field of a fact that every profile has: it meets each exclusion and each rule set, also where no other fact does.
_EVERY = " every"


def _small(table: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(table) if few else table


def _entries(profiles: DataFrame) -> DataFrame:
    """facts_of() with one more row for each profile, of member -1 and the field _EVERY, and the number of members there.

    An applicant without record counts as one without facts, as in compiled rules.
    """
    kind = profiles.schema["members"].dataType.elementType.simpleString()
    every = F.array(F.expr(f"CAST(named_struct('ix', NULL, 'facts', map('{_EVERY}', NULL)) AS {kind})"))
    one = prepared(profiles).select("profile_id", F.size("_fam").alias("members"), F.posexplode(F.concat(every, "_fam")).alias("p", "m"))
    named = one.select("profile_id", (F.col("p") - 1).alias("member_ix"), F.when(F.col("p") == 0, F.col("members")).alias("members"), F.explode("m.facts").alias("field", "value"))
    return named.withColumn("field", F.when(F.col("member_ix") == -1, F.lit(_EVERY)).otherwise(F.col("field")))


_RULE = ["scheme_id", "path", "location", "field", "op", "value", "quantifier", "except_scope", "count_op", "count"]


def _rule_sets(rows: list[Row]) -> list[RuleSet] | None:
    """The rule sets that rows of the flat table are, values as they are there; None where rows are missing, twice, or of no known form."""
    found: dict[Any, dict[str, Row]] = {}
    for row in rows:
        if None in (row.scheme_id, row.path, row.field, row.value) or row.path.count(".") > DEEP or row.op not in OPERATORS or found.setdefault(row.scheme_id, {}).setdefault(row.path, row) is not row:
            return None

    def tree(path: str, some: dict[str, Row]) -> Any:
        if path in some:
            return Leaf(some[path].field, some[path].op, some[path].value)
        below = {(m[1], int(m[2])) for p in some if (m := re.match(rf"{re.escape(path)}\.(and|or)\[(\d+)\]", p))}
        return Node(max(below)[0], tuple(tree(f"{path}.{kind}[{i}]", some) for kind, i in sorted(below))) if below else None

    made = []
    for scheme, some in found.items():
        trees, held, spared = ({p: r for p, r in some.items() if r.location == x} for x in ("inclusion", "exclusion", "exception"))
        out = []
        for path, r in held.items():
            e = spared.pop(f"{path}.except", None)
            out.append(Exclusion(r.field, r.op, r.value, "other", r.quantifier, r.count_op, r["count"], e and Leaf(e.field, e.op, e.value), e.except_scope if e else "member"))
        inclusion = tree("inclusion", trees)
        counts = all(x.count_op in COUNT_OPERATORS and x.count is not None for x in out if x.quantifier == "count_family_members")
        if not trees or spared or len(trees) + len(held) != sum(r.location != "exception" for r in some.values()) or inclusion is None or {p for p, _ in leaves(inclusion)} != set(trees):
            return None
        if not counts or not all(x.quantifier in QUANTIFIERS and x.except_scope in SCOPES for x in out) or not all(p.startswith("exclusion") for p in held):
            return None
        made.append(RuleSet(scheme, inclusion, tuple(out)))
    return made


def _result(leaf: Leaf | Exclusion, facts: Column) -> Column:
    """leaf_result() of a leaf with a tagged value, as the joins compare it."""
    v = leaf.value
    listed = F.lit(None) if v["arr"] is None else F.array(*map(F.lit, v["arr"]))
    expected = F.struct(F.lit(v["kind"]).alias("kind"), F.lit(v["num"]).cast("double").alias("num"), F.lit(v["str"]).cast("string").alias("str"), listed.cast("array<string>").alias("arr"))
    return F.when(F.map_contains_key(facts, leaf.field), compare_columns(F.lit(leaf.op), facts[leaf.field], expected))


def _compiled(profiles: DataFrame, rule_sets: list[RuleSet], kind: str) -> DataFrame:
    wide = outcomes(profiles, rule_sets, _result).select("profile_id", *[F.array(*[F.col(f"{c}_{k}") for k in range(len(rule_sets))]).alias(c) for c in ("included", "excluded")])
    rows = wide.select("*", F.posexplode(F.array(*[F.lit(r.scheme_id).cast(kind) for r in rule_sets])).alias("_k", "scheme_id"))
    rows = rows.select("profile_id", "scheme_id", *[F.get(c, F.col("_k")).alias(c) for c in ("included", "excluded")])
    return rows.select("profile_id", "scheme_id", verdict(F.col("included"), F.col("excluded")).alias("verdict"), "included", "excluded")


def verdicts(profiles: DataFrame, flat: DataFrame) -> DataFrame:
    """profile_id, scheme_id, verdict, included, excluded of every profile and rule set, for rules that arrive as data.

    Up to COMPILED rules of known form are read from their table and give columns of a profile's own row. Others are
    joined: all sums are over keys that begin with the profile, so profiles that are dealt by their id are not dealt again.
    Inclusion trees are folded from the deepest level up: a node is decided by how many of its children are true and
    false, out of how many the rule table says it has. A value that can't be compared counts as unknown here, where
    compiled rules give an error.
    """
    rows = flat.select(*_RULE).limit(COMPILED + 1).collect()
    if 0 < len(rows) <= COMPILED and (rule_sets := _rule_sets(rows)):
        return _compiled(profiles, rule_sets, flat.schema["scheme_id"].dataType.simpleString())
    size, depth = flat.agg(F.count("*"), F.max(F.when(F.col("location") == "inclusion", F.size(F.split("path", r"\."))))).first()
    few = size <= SENT
    base = F.regexp_replace("path", r"\.except$", "")
    own = (F.col("location") == "inclusion") | (F.col("quantifier") == "self") | (F.col("except_scope") == "applicant")
    part = F.when(F.col("location") != "exception", "hit").when(F.col("except_scope") == "applicant", "waiver").when(F.col("except_scope") == "member", "exempt")
    rules = flat.select("scheme_id", base.alias("path"), "field", "op", F.col("value").alias("expected"), F.coalesce(own, F.lit(False)).alias("own"), part.alias("part")).where("part IS NOT NULL")
    held = flat.where("location = 'exclusion'").select("scheme_id", "path")
    every = held.unionByName(flat.select("scheme_id", F.lit("").alias("path")).distinct()).withColumn("field", F.lit(_EVERY))
    met = _entries(profiles).join(_small(rules.unionByName(every, allowMissingColumns=True), few), "field").where("NOT coalesce(own, FALSE) OR member_ix = 0")
    met = met.withColumn("result", compare_columns(F.col("op"), F.col("value"), F.col("expected")))
    # each exclusion of each member, and each inclusion leaf
    per = met.groupBy("profile_id", "scheme_id", "path", "member_ix").agg(F.max("members").alias("members"), *[F.max(F.when(F.col("part") == x, F.col("result"))).alias(x) for x in ("hit", "exempt", "waiver")])
    scoped = flat.where("location = 'exception' AND except_scope IN ('member', 'applicant')").groupBy("scheme_id", base.alias("path")).agg(F.bool_or(F.col("except_scope") == "member").alias("spared"), F.bool_or(F.col("except_scope") == "applicant").alias("waivable"))
    about = flat.where("location = 'exclusion'").select("scheme_id", "path", "quantifier", "count_op", "count").join(scoped, ["scheme_id", "path"], "left")
    about = _small(about, few)
    per = per.join(about.select("scheme_id", "path", "spared"), ["scheme_id", "path"], "left").withColumn("r", F.when(F.coalesce("spared", F.lit(False)), F.col("hit") & ~F.col("exempt")).otherwise(F.col("hit")))
    sums = per.groupBy("profile_id", "scheme_id", "path").agg(F.max("members").alias("members"), F.count_if("r").alias("t"), F.count_if(~F.col("r")).alias("f"), F.max("waiver").alias("waived")).join(about, ["scheme_id", "path"], "left")
    q, t, f = F.col("quantifier"), F.col("t"), F.col("f")
    u = F.when(q == "self", 1).otherwise(F.col("members")) - t - f
    counted = F.lit(None).cast("boolean")
    for op in ("<", "<=", "==", ">", ">="):
        counted = F.when(F.col("count_op") == op, kleene.count_range(op, t, t + u, F.col("count"))).otherwise(counted)
    result = F.when(q == "count_family_members", counted).when(q == "all_family_members", kleene.from_counts("and", t, f, u)).otherwise(kleene.from_counts("or", t, f, u))
    result = F.when(F.coalesce("waivable", F.lit(False)), result & ~F.col("waived")).otherwise(result)
    leaf = F.when(t > 0, True).when(f > 0, False)
    found = sums.select("profile_id", "scheme_id", "path", F.when(F.startswith(F.col("path"), F.lit("inclusion")), leaf).when(F.col("path") != "", result).alias("result"))

    parent = lambda c: F.regexp_replace(c, r"\.(?:and|or)\[\d+\]$", "")
    nodes = flat.where("location = 'inclusion'").select("scheme_id", "path")
    for level in range(depth or 1, 1, -1):
        here = F.size(F.split("path", r"\.")) == level
        kinds = nodes.where(here).select("scheme_id", parent(F.col("path")).alias("path"), F.regexp_extract("path", r"\.(and|or)\[\d+\]$", 1).alias("kind")).groupBy("scheme_id", "path", "kind").agg(F.count("*").alias("n"))
        up = found.groupBy("profile_id", "scheme_id", F.when(here, parent(F.col("path"))).otherwise(F.col("path")).alias("path")).agg(F.max("result").alias("result"), F.count_if("result").alias("t"), F.count_if(~F.col("result")).alias("f"))
        decided = from_counts_by(F.col("kind"), F.col("t"), F.col("f"), F.col("n") - F.col("t") - F.col("f"))
        found = up.join(_small(kinds, few), ["scheme_id", "path"], "left").select("profile_id", "scheme_id", "path", F.when(F.col("kind").isNull(), F.col("result")).otherwise(decided).alias("result"))
        nodes = nodes.where(~here).unionByName(kinds.select("scheme_id", "path"))
    out = F.startswith(F.col("path"), F.lit("exclusion"))
    true, false, open_ = (F.count_if(out & x) for x in (F.col("result"), ~F.col("result"), F.col("result").isNull()))
    both = found.groupBy("profile_id", "scheme_id").agg(F.max(F.when(F.col("path") == "inclusion", F.col("result"))).alias("included"), kleene.from_counts("or", true, false, open_).alias("excluded"))
    return both.select("profile_id", "scheme_id", verdict(F.col("included"), F.col("excluded")).alias("verdict"), "included", "excluded")
