"""Validation of flat rules, and what rules read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake.plans import rulesets as R

GENERIC_FIELDS = ("is_indian_citizen", "is_resident", "has_aadhaar")


def reasons(*checks: tuple[Column, str]) -> Column:
    """Names of the checks that fail; a check that gives null passes."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), name) for ok, name in checks]))


def validate_flat(flat: DataFrame) -> DataFrame:
    """Adds faults to flat rules: vocabulary of cat, op, quantifier and scope."""
    cats = (*R.CATEGORIES, R.EXCEPTION_CATEGORY)
    return flat.withColumn("faults", reasons((F.col("cat").isin(*cats), "cat"), (F.col("op").isin(*R.OPERATORS), "op"), (F.col("quantifier").isin(*R.QUANTIFIERS), "quantifier"), (F.col("except_scope").isin(*R.SCOPES), "except_scope"), (F.col("field") != "", "field")))


def validate_exclusions(exclusions: DataFrame) -> DataFrame:
    """Adds faults to exclusions (quantifier, count_op, count, has_except, except_scope)."""
    counted = F.col("quantifier") == "count_family_members"
    return exclusions.withColumn("faults", reasons(
        (F.col("has_except") | (F.coalesce("except_scope", F.lit("member")) == "member"), "scope without exception"),
        (~((F.col("except_scope") == "applicant") & (F.col("quantifier") == "self")), "applicant scope with self"),
        (~(counted & F.col("has_except") & (F.coalesce("except_scope", F.lit("member")) == "member") & F.col("count_op").isin("<", "<=", "==")), "member exception with a falling count"),
        (counted == (F.col("count_op").isNotNull() & F.col("count").isNotNull()), "count fields"),
        (F.col("count") >= 0, "negative count"),
    ))


def validate_dates(rule_sets: DataFrame) -> DataFrame:
    """Adds faults: valid_to before valid_from, confidence outside 0 to 1."""
    return rule_sets.withColumn("faults", reasons((F.col("valid_to") >= F.col("valid_from"), "dates"), (F.col("confidence").between(0, 1), "confidence")))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without faults, without that column; and the others with it."""
    return checked.where(F.size("faults") == 0).drop("faults"), checked.where(F.size("faults") > 0)


def force_member_scope(flat: DataFrame) -> DataFrame:
    """Exceptions of machine-made rules are read from the member who triggers the exclusion."""
    return flat.withColumn("except_scope", F.when(F.col("except_scope").isNotNull(), "member"))


def is_vacuous(flat: DataFrame) -> DataFrame:
    """scheme_id, vacuous: no inclusion leaf beyond generic fields and no exclusion."""
    telling = ((F.col("location") == "inclusion") & ~F.col("field").isin(*GENERIC_FIELDS)) | (F.col("location") == "exclusion")
    return flat.groupBy("scheme_id").agg((F.count_if(telling) == 0).alias("vacuous"))


def family_wide_fields(flat: DataFrame) -> DataFrame:
    """Fields that only exclusions over the family read: scheme_id, field."""
    family = flat.where("location = 'exclusion' AND quantifier <> 'self'").select("scheme_id", "field").distinct()
    own = flat.where("location = 'inclusion' OR (location = 'exclusion' AND quantifier = 'self') OR except_scope = 'applicant'").select("scheme_id", "field").distinct()
    return family.join(own, ["scheme_id", "field"], "left_anti")


def predicates_per_scheme(flat: DataFrame) -> DataFrame:
    """scheme_id, location, n with totals (null) by rollup."""
    return flat.rollup("scheme_id", "location").agg(F.count("*").alias("n"))


def candidate_values(flat: DataFrame) -> DataFrame:
    """Values that decide each field, one for each region between thresholds: scheme_id, field, value (a string).

    Numbers: each threshold, one below and above all, midpoints. Booleans: both. Strings and lists: those named and
    one that matches none.
    """
    num = flat.where("value.kind = 'num'").groupBy("scheme_id", "field").agg(F.array_sort(F.collect_set("value.num")).alias("t"))
    middle = F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: (F.get("t", i) + F.get("t", i - 1)) / 2)
    grid = F.array_distinct(F.concat("t", F.array(F.element_at("t", 1) - 1, F.element_at("t", -1) + 1), F.when(F.size("t") > 1, middle).otherwise(F.expr("CAST(array() AS ARRAY<DOUBLE>)"))))
    numbers = num.select("scheme_id", "field", F.explode(grid).alias("v")).select("scheme_id", "field", F.col("v").cast("string").alias("value"))
    bools = flat.where("value.kind = 'bool'").select("scheme_id", "field", F.explode(F.array(F.lit("true"), F.lit("false"))).alias("value"))
    named = flat.where("value.kind IN ('str', 'list')").select("scheme_id", "field", F.explode(F.concat(F.coalesce("value.arr", F.array(F.concat(F.lit("s:"), "value.str"))), F.array(F.lit("s:<none of these>")))).alias("v")).select("scheme_id", "field", F.expr("substring(v, 3)").alias("value"))
    return numbers.unionByName(bools).unionByName(named).distinct()


def diff_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fields of two copies that differ: scheme_id, path, old_value, new_value by null-safe full join."""
    a = old.select("scheme_id", "path", F.concat_ws(" ", "field", "op", "value_repr").alias("old_value"))
    b = new.select("scheme_id", "path", F.concat_ws(" ", "field", "op", "value_repr").alias("new_value"))
    return a.join(b, ["scheme_id", "path"], "full").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def detect(flat: DataFrame, detectors: list[dict]) -> DataFrame:
    """Rule detectors as rows: name, seen for each scheme. A detector has a field pattern, and maybe location, ops, lo, hi."""

    def hit(d: dict) -> Column:
        ok = F.col("field").rlike(d["field"])
        if d.get("location"):
            ok &= F.col("location") == d["location"]
        if d.get("ops"):
            ok &= F.col("op").isin(*d["ops"])
        if d.get("lo") is not None:
            ok &= F.col("value.num") >= d["lo"]
        return ok & (F.col("value.num") <= d["hi"]) if d.get("hi") is not None else ok

    seen = flat.groupBy("scheme_id").agg(*[F.coalesce(F.max(hit(d)), F.lit(False)).alias(d["name"]) for d in detectors])
    return seen.unpivot("scheme_id", [d["name"] for d in detectors], "name", "seen")


def check_expected(seen: DataFrame, expected: DataFrame) -> DataFrame:
    """seen (scheme_id, name, seen) against expected (scheme_id, name, expected): adds as_expected; unseen schemes count as not seen."""
    return expected.join(seen, ["scheme_id", "name"], "left").withColumn("seen", F.coalesce("seen", F.lit(False))).withColumn("as_expected", F.col("seen") == F.col("expected"))
