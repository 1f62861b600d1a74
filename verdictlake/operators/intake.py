"""What model output becomes before it is a rule set, a profile or an answer: validated rows, and failures with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdictlake.plans.rulesets import CATEGORIES, OPERATORS

VERDICTS = ("eligible", "ineligible", "undetermined_missing_facts")
# What error texts say, most telling first.
TRUNCATED, RATE_LIMITED, DAILY = ("json_validate_failed", "max completion tokens reached"), ("rate_limit", "429", "tokens per", "requests per"), ("tokens per day", "requests per day")


def flat_to_rules(criteria: DataFrame) -> tuple[DataFrame, DataFrame]:
    """criteria (doc_id, ordinal, kind, field, op, value_repr, cat) to flat rules and failures (doc_id, reason).

    Required ones are joined by AND, disqualifying ones are exclusions of the applicant; a missing category is other.
    A document without a required one, or with a word outside the vocabularies, fails as a whole.
    """
    rows = criteria.where(F.col("kind").isin("required", "disqualifying")).withColumn("cat", F.when(F.coalesce("cat", F.lit("")) == "", "other").otherwise(F.col("cat")))
    bad = ~F.coalesce(F.col("op").isin(*OPERATORS) & F.col("cat").isin(*CATEGORIES) & (F.col("field") != ""), F.lit(False))
    docs = criteria.groupBy("doc_id").agg(F.count_if(F.col("kind") == "required").alias("required"))
    faulty = rows.groupBy("doc_id").agg(F.count_if(bad).alias("faults"))
    judged = docs.join(faulty, "doc_id", "left").withColumn("reason", F.when(F.col("required") == 0, "no required condition").when(F.col("faults") > 0, "schema validation failed"))
    good = rows.join(judged.where("reason IS NULL").select("doc_id"), "doc_id", "left_semi")
    required = F.col("kind") == "required"
    place = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("ordinal")) - 1
    path = F.when(required, F.concat(F.lit("inclusion.and["), place, F.lit("]"))).otherwise(F.concat(F.lit("exclusions["), place, F.lit("]")))
    flat = good.select("doc_id", path.alias("path"), F.when(required, "inclusion").otherwise("exclusion").alias("location"), "field", "cat", "op", "value_repr", F.when(~required, "self").alias("quantifier"))
    return flat, judged.where("reason IS NOT NULL").select("doc_id", "reason")


def merge_extraction(core: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two halves of extractions (doc_id, ...) as one row each; and the documents that lack one, with the reason.

    A half with a reason of its own (column reason) is a failed one and passes it on, the core's first.
    """
    a, b = core.withColumnRenamed("reason", "_a").withColumn("_has_a", F.lit(True)), metadata.withColumnRenamed("reason", "_b").withColumn("_has_b", F.lit(True))
    rows = a.join(b, "doc_id", "full")
    why = F.coalesce("_a", F.when(F.col("_has_a").isNull(), "core missing"), "_b", F.when(F.col("_has_b").isNull(), "metadata missing"))
    rows = rows.withColumn("reason", why).drop("_a", "_b", "_has_a", "_has_b")
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL").select("doc_id", "reason")


def stamp_provenance(results: DataFrame, text: str, **labels: str) -> DataFrame:
    """Adds labels (tag, commit, provider, model, configuration, date) and the SHA-256 of the source text."""
    return results.withColumns({**{k: F.lit(v) for k, v in labels.items()}, "source_sha256": F.sha2(F.coalesce(F.col(text), F.lit("")), 256)})


def classify_failure(detail: Column) -> Column:
    """struct<reason, retryable> of an error text; a daily limit is not worth another attempt."""
    d = F.lower(F.coalesce(detail, F.lit("")))
    says = lambda marks: d.rlike("|".join(marks))
    reason = F.when(says(TRUNCATED), "truncated_completion_budget").when(says(RATE_LIMITED), "rate_limited").otherwise("api_error")
    return F.struct(reason.alias("reason"), ((reason == "rate_limited") & ~says(DAILY)).alias("retryable"))


def validate_direct_answers(answers: DataFrame) -> DataFrame:
    """answers (..., content: JSON) with verdict, reason of 500 characters at most, and failure where they can't be used."""
    parsed = F.from_json("content", "verdict STRING, reason STRING")
    verdict = F.lower(F.trim(parsed["verdict"]))
    fine = F.coalesce(verdict.isin(*VERDICTS), F.lit(False))
    return answers.withColumns({"verdict": F.when(fine, verdict), "reason": F.when(fine, F.left(F.coalesce(parsed["reason"], F.lit("")), F.lit(500))), "failure": F.when(~fine, F.when(F.coalesce(verdict, F.lit("")) == "", "unparseable response").otherwise("unrecognized verdict"))})


def intake_shape(profiles: DataFrame, content: str) -> DataFrame:
    """Adds own (a map as JSON) and family (a list as JSON) of profiles in JSON; what has another shape counts as empty."""
    part = lambda name: F.get_json_object(content, f"$.{name}")
    shaped = lambda c, first, empty: F.when(F.coalesce(F.left(F.ltrim(c), F.lit(1)), F.lit("")) == first, c).otherwise(empty)
    return profiles.withColumns({"own": shaped(part("self"), "{", "{}"), "family": shaped(part("family_members"), "[", "[]")})
