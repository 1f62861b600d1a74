"""Rule sets as configuration: trees of predicates and exclusions, and the tables they flatten to."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdictlake.functions.values import tagged
from verdictlake.sources.shared import frozen

# The closed vocabularies of rules.
CATEGORIES = ("citizenship", "demographic", "occupation", "economic", "political", "professional", "institutional", "family_unit", "temporal", "cross_scheme", "vacuous", "other")
OPERATORS = ("==", "!=", "<", "<=", ">", ">=", "in", "not_in")
QUANTIFIERS = ("self", "some_family_member", "all_family_members", "count_family_members")
SCOPES = ("member", "applicant")
COUNT_OPERATORS = ("<", "<=", "==", ">", ">=")
EXCEPTION_CATEGORY = "exception_to_exclusion"


@dataclass(frozen=True)
class Leaf:
    field: str
    op: str
    value: Any
    cat: str = "other"


@dataclass(frozen=True)
class Node:
    """kind "and" or "or" over its children."""

    kind: str
    children: tuple


@dataclass(frozen=True)
class Exclusion:
    field: str
    op: str
    value: Any
    cat: str = "other"
    quantifier: str = "self"
    count_op: str | None = None
    count: int | None = None
    exception: Leaf | None = None
    except_scope: str = "member"


@dataclass(frozen=True)
class RuleSet:
    scheme_id: str
    inclusion: Any
    exclusions: tuple[Exclusion, ...] = ()
    version: str = "1"
    requirements: tuple[str, ...] = ()
    meta: dict = field(default_factory=dict, compare=False, hash=False)


def leaves(node: Any, path: str = "inclusion") -> Iterator[tuple[str, Leaf]]:
    """Leaves of a tree from left to right, with paths such as inclusion.and[1].or[0]."""
    if isinstance(node, Leaf):
        yield path, node
        return
    for i, child in enumerate(node.children):
        yield from leaves(child, f"{path}.{node.kind}[{i}]")


FLAT = f"scheme_id STRING, version STRING, ordinal INT, path STRING, location STRING, field STRING, cat STRING, op STRING, value {'STRUCT<kind: STRING, num: DOUBLE, str: STRING, arr: ARRAY<STRING>>'}, value_repr STRING, quantifier STRING, has_except BOOLEAN, parent_field STRING, except_scope STRING, count_op STRING, count INT"


def flat_rows(rules: RuleSet) -> list[tuple]:
    """Inclusion leaves, then exclusions, then exceptions; value_repr keeps 1, 1.0 and True apart."""
    out: list[tuple] = []

    def add(path: str, location: str, f: str, cat: str, op: str, value: Any, quantifier: str | None = None, has: bool = False, parent: str | None = None, scope: str | None = None, count_op: str | None = None, count: int | None = None) -> None:
        out.append((rules.scheme_id, rules.version, len(out), path, location, f, cat, op, tagged(value), repr(value), quantifier, has, parent, scope, count_op, count))

    for path, leaf in leaves(rules.inclusion):
        add(path, "inclusion", leaf.field, leaf.cat, leaf.op, leaf.value)
    for i, x in enumerate(rules.exclusions):
        add(f"exclusions[{i}]", "exclusion", x.field, x.cat, x.op, x.value, x.quantifier, x.exception is not None, count_op=x.count_op, count=x.count)
    for i, x in enumerate(rules.exclusions):
        if x.exception:
            add(f"exclusions[{i}].except", "exception", x.exception.field, EXCEPTION_CATEGORY, x.exception.op, x.exception.value, parent=x.field, scope=x.except_scope)
    return out


def flat_table(spark: SparkSession, rule_sets: list[RuleSet]) -> DataFrame:
    return spark.createDataFrame([row for r in rule_sets for row in flat_rows(r)], FLAT)


def from_dict(data: dict) -> RuleSet:
    """A rule set from its JSON form; omitted fields take their defaults."""

    def tree(d: dict) -> Any:
        for kind in ("and", "or"):
            if kind in d:
                return Node(kind, tuple(tree(c) for c in d[kind]))
        return Leaf(d["field"], d["op"], d["value"], d.get("cat", "other"))

    def exclusion(d: dict) -> Exclusion:
        e = d.get("except")
        return Exclusion(d["field"], d["op"], d["value"], d.get("cat", "other"), d.get("quantifier", "self"), d.get("count_op"), d.get("count"), Leaf(e["field"], e["op"], e["value"]) if e else None, d.get("except_scope", "member"))

    return RuleSet(data["scheme_id"], tree(data["inclusion"]), tuple(exclusion(x) for x in data.get("exclusions", ())), str(data.get("version", "1")), tuple(data.get("operational_requirements", ())), {k: data.get(k) for k in ("unit_of_eligibility", "temporal_validity", "extraction_metadata")})


def to_dict(rules: RuleSet) -> dict:
    """The JSON form, defaults omitted."""

    def tree(node: Any) -> dict:
        if isinstance(node, Leaf):
            return {"field": node.field, "op": node.op, "value": node.value, "cat": node.cat}
        return {node.kind: [tree(c) for c in node.children]}

    def exclusion(x: Exclusion) -> dict:
        out = {"field": x.field, "op": x.op, "value": x.value, "cat": x.cat, "quantifier": x.quantifier}
        if x.count_op is not None:
            out |= {"count_op": x.count_op, "count": x.count}
        if x.exception:
            out["except"] = {"field": x.exception.field, "op": x.exception.op, "value": x.exception.value}
            if x.except_scope != "member":
                out["except_scope"] = x.except_scope
        return out

    out = {"scheme_id": rules.scheme_id, "version": rules.version, "inclusion": tree(rules.inclusion), "exclusions": [exclusion(x) for x in rules.exclusions]}
    if rules.requirements:
        out["operational_requirements"] = list(rules.requirements)
    return out | {k: v for k, v in rules.meta.items() if v is not None}


def flatten_json(rules: DataFrame) -> DataFrame:
    """Rule sets as JSON text (scheme_id, rules) to their predicates, for any number of rule sets.

    scheme_id, ordinal, path, location, field, op, value_json, quantifier, parent_field, except_scope: inclusion leaves
    from left to right, then exclusions, then exceptions. Trees are opened a level at a time, with as many steps as the
    deepest one has levels, each computed once; omitted fields take their defaults. Texts that are no JSON give no rows:
    schema_faults() lists them.
    """
    spark = rules.sparkSession
    part = lambda node, name: F.variant_get(node, f"$.{name}", "variant")
    text = lambda node, name: F.variant_get(node, f"$.{name}", "string")
    opened = lambda df, what: df.lateralJoin(spark.tvf.variant_explode(what.outer()).select(F.col("pos"), F.col("value").alias("child")))
    whole = rules.select("scheme_id", F.try_parse_json("rules").alias("v")).where("v IS NOT NULL")
    columns = ["scheme_id", "section", "place", "path", "node", "parent_field", "except_scope"]
    none = F.lit(None).cast("string")
    nodes = whole.select("scheme_id", F.lit(0).alias("section"), F.expr("CAST(array() AS ARRAY<INT>)").alias("place"), F.lit("inclusion").alias("path"), part(F.col("v"), "inclusion").alias("node"), none.alias("parent_field"), none.alias("except_scope"))
    found = None
    while True:
        nodes = frozen(nodes)
        children = F.coalesce(part(F.col("node"), "and"), part(F.col("node"), "or"))
        here = nodes.where(children.isNull() & F.col("node").isNotNull())
        found = here if found is None else found.unionByName(here)
        inner = nodes.where(children.isNotNull()).withColumn("kids", children).withColumn("kind", F.when(part(F.col("node"), "and").isNotNull(), "and").otherwise("or"))
        if inner.isEmpty():
            break
        nodes = opened(inner, F.col("kids")).select("scheme_id", "section", F.array_append("place", F.col("pos")).alias("place"), F.concat("path", F.lit("."), "kind", F.lit("["), "pos", F.lit("]")).alias("path"), F.col("child").alias("node"), "parent_field", "except_scope")
    listed = whole.withColumn("kids", part(F.col("v"), "exclusions")).where("kids IS NOT NULL")
    excluded = opened(listed, F.col("kids")).where("child IS NOT NULL").select("scheme_id", F.lit(1).alias("section"), F.array("pos").alias("place"), F.concat(F.lit("exclusions["), "pos", F.lit("]")).alias("path"), F.col("child").alias("node"), none.alias("parent_field"), none.alias("except_scope"))
    spared = excluded.select("scheme_id", F.lit(2).alias("section"), "place", F.concat("path", F.lit(".except")).alias("path"), part(F.col("node"), "except").alias("n"), text(F.col("node"), "field").alias("parent_field"), F.coalesce(text(F.col("node"), "except_scope"), F.lit("member")).alias("except_scope")).where("n IS NOT NULL").withColumnRenamed("n", "node")
    rows = found.unionByName(excluded).unionByName(spared.select(*columns))
    node, section = F.col("node"), F.col("section")
    order = F.row_number().over(Window.partitionBy("scheme_id").orderBy("section", "place")) - 1
    quantifier = F.when(section == 1, F.coalesce(text(node, "quantifier"), F.lit("self")))
    return rows.select("scheme_id", order.alias("ordinal"), "path", F.when(section == 0, "inclusion").when(section == 1, "exclusion").otherwise("exception").alias("location"), text(node, "field").alias("field"), text(node, "op").alias("op"), F.to_json(part(node, "value")).alias("value_json"), quantifier.alias("quantifier"), "parent_field", "except_scope")
