"""The closed schema of rule sets as JSON: every key, its types and values, checked on Spark over texts of any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake.plans import rulesets as R
from verdictlake.sources.shared import frozen

TEXT, BOOL, COUNT, NUMBER, LIST, OBJECT, ANY = "text", "bool", "int", "number", "list", "object", "any"
_PREDICATE = {"field": (TEXT,), "op": (TEXT, R.OPERATORS), "value": (ANY,), "ontology_proposed": (BOOL,)}
# For each kind of object its keys with type, allowed values or the kind of what is inside; and those it has to have.
KEYS: dict[str, dict[str, tuple]] = {
    "rules": {"scheme_id": (TEXT,), "version": (TEXT,), "unit_of_eligibility": (TEXT,), "inclusion": (OBJECT, "node"), "exclusions": (LIST, "exclusion"), "operational_requirements": (LIST, TEXT), "temporal_validity": (OBJECT, "temporal"), "extraction_metadata": (OBJECT, "metadata")},
    "and": {"and": (LIST, "node")},
    "or": {"or": (LIST, "node")},
    "predicate": _PREDICATE | {"cat": (TEXT, R.CATEGORIES)},
    "exclusion": _PREDICATE | {"cat": (TEXT, R.CATEGORIES), "quantifier": (TEXT, R.QUANTIFIERS), "except": (OBJECT, "exception"), "except_scope": (TEXT, R.SCOPES), "count_op": (TEXT, R.COUNT_OPERATORS), "count": (COUNT,)},
    "exception": _PREDICATE,
    "temporal": {"valid_from": (TEXT,), "valid_to": (TEXT,), "extracted_at": (TEXT,), "supersedes": (OBJECT, "supersedes")},
    "supersedes": {"rule_version": (TEXT,), "retired_predicate": (OBJECT, ANY), "amendment_source": (TEXT,)},
    "metadata": {"confidence": (NUMBER,), "source_clause": (TEXT,), "flagged_for_review": (BOOL,)},
}
NEEDED = {"rules": ("scheme_id", "inclusion"), "and": ("and",), "or": ("or",), "predicate": ("field", "op", "value", "cat"), "exclusion": ("field", "op", "value", "cat"), "exception": ("field", "op", "value"), "temporal": ("extracted_at",), "supersedes": ("rule_version", "retired_predicate", "amendment_source"), "metadata": ("confidence", "source_clause")}
#: Keys that may be null.
NULLABLE = ("valid_from", "valid_to", "supersedes", "except", "count_op", "count", "unit_of_eligibility", "temporal_validity", "extraction_metadata")


def _type(v: Column) -> Column:
    """The type of a variant in this schema's words."""
    name = F.schema_of_variant(v)
    return F.when(name == "STRING", TEXT).when(name == "BOOLEAN", BOOL).when(name == "BIGINT", COUNT).when(name.rlike("^(DECIMAL|DOUBLE|FLOAT)"), NUMBER).when(name.startswith("ARRAY"), LIST).when(name.startswith("OBJECT"), OBJECT).otherwise("null")


def _table(pick) -> Column:
    """A map from kind and key, as kind.key, to what pick(spec) gives; keys for which that is None are left out."""
    return F.create_map(*[F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for kind, keys in KEYS.items() for key, spec in keys.items() if (found := pick(spec)) is not None for x in (f"{kind}.{key}", found)])


def schema_faults(rules: DataFrame) -> DataFrame:
    """scheme_id, path, fault for everything in rule sets as JSON texts (scheme_id, rules) that the closed schema does not have.

    Faults: `not JSON` (null texts too), `unknown key`, `missing key`, `wrong type` and `unknown value`; a valid rule set
    gives no row. Texts are parsed to VARIANT and walked a level at a time, each level's objects computed once; what is
    inside an unknown key or a value of a wrong type is not looked at. A node of a tree is told by its keys: `and`,
    `or`, else a predicate. Repeated rows give repeated faults.
    """
    none = F.lit(None).cast("string")
    row = lambda path, kind, v, fault: ("scheme_id", path.alias("path"), kind.alias("kind"), v.alias("v"), fault.alias("fault"))
    bad = lambda path, fault: row(path, none, F.lit(None).cast("variant"), fault)
    # dealt first: every level runs in as many tasks as the texts lie in, and a small file would be one
    whole = rules.select("scheme_id", "rules").repartition("scheme_id", "rules").select("scheme_id", F.try_parse_json("rules").alias("v"))
    step = frozen(whole.select(*row(F.lit(""), F.lit("rules"), F.col("v"), F.when(F.col("v").isNull(), "not JSON"))))
    found = step.where("fault IS NOT NULL").select("scheme_id", "path", "fault")
    at = F.concat_ws(".", "kind", "key")
    dotted = F.when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key"))
    needed = F.create_map(*[x for kind, keys in NEEDED.items() for x in (F.lit(kind), F.array(*map(F.lit, keys)))])
    while not (level := step.where("fault IS NULL")).isEmpty():
        level = level.withColumn("is", _type(F.col("v")))
        objects = level.where(F.col("is") == OBJECT).select("scheme_id", "path", "kind", F.try_variant_get("v", "$", "map<string,variant>").alias("m"))
        has = lambda k: F.map_contains_key("m", k)
        objects = objects.withColumn("kind", F.when(F.col("kind") != "node", F.col("kind")).when(has("and"), "and").when(has("or"), "or").otherwise("predicate"))
        lacks = F.filter(F.element_at(needed, F.col("kind")), lambda k: ~F.map_contains_key("m", k))
        missing = objects.select("scheme_id", "path", F.explode(lacks).alias("key"))
        entries = objects.select("scheme_id", "path", "kind", F.explode("m").alias("key", "v")).withColumn("is", _type(F.col("v")))
        entries = entries.select("scheme_id", dotted.alias("path"), "key", "v", "is", F.element_at(_table(lambda s: s[0]), at).alias("want"), F.element_at(_table(lambda s: list(s[1]) if len(s) > 1 and isinstance(s[1], tuple) else None), at).alias("values"), F.element_at(_table(lambda s: s[1] if len(s) > 1 and isinstance(s[1], str) else None), at).alias("inside"))
        fits = (F.col("want") == ANY) | (F.col("want") == F.col("is")) | ((F.col("want") == NUMBER) & (F.col("is") == COUNT)) | ((F.col("is") == "null") & F.col("key").isin(*NULLABLE))
        listed = F.col("values").isNull() | (F.col("is") == "null") | F.array_contains("values", F.try_variant_get("v", "$", "string"))
        fault = F.when(F.col("want").isNull(), "unknown key").when(~fits, "wrong type").when(~listed, "unknown value")
        goes_on = F.col("fault").isNull() & F.col("is").isin(LIST, OBJECT) & F.col("inside").isNotNull() & (F.col("inside") != ANY)
        judged = entries.withColumn("fault", fault).where(F.col("fault").isNotNull() | goes_on)
        # a faulty entry stays as it is, an object is one row, a list a row for each element
        parts = F.when(F.col("fault").isNull() & (F.col("is") == LIST), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
        listing = F.col("fault").isNull() & (F.col("is") == LIST)
        opened = judged.select("scheme_id", "path", "inside", "fault", listing.alias("listing"), F.posexplode(parts).alias("n", "v"))
        place = F.when(F.col("listing"), F.concat("path", F.lit("["), "n", F.lit("]"))).otherwise(F.col("path"))
        texts = F.when(F.col("inside") == TEXT, F.when(_type(F.col("v")) != TEXT, "wrong type").otherwise(""))
        opened = opened.select(*row(place, F.col("inside"), F.col("v"), F.coalesce("fault", texts))).where("fault IS NULL OR fault <> ''")
        wrong = level.where(F.col("is") != OBJECT).select(*bad(F.col("path"), F.lit("wrong type")))
        step = frozen(opened.unionByName(wrong).unionByName(missing.select(*bad(dotted, F.lit("missing key")))))
        found = found.unionByName(step.where("fault IS NOT NULL").select("scheme_id", "path", "fault"))
    return found


def split_by_schema(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rule sets that the closed schema allows, and a quarantine of the others with their faults; scheme_id has to tell rows apart."""
    faults = schema_faults(rules).groupBy("scheme_id").agg(F.array_sort(F.collect_list(F.struct("path", "fault"))).alias("faults"))
    return rules.join(faults.select("scheme_id"), "scheme_id", "left_anti"), rules.join(faults, "scheme_id")
