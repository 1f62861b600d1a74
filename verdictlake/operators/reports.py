"""Reports over scored runs: configurations side by side, injected errors, amendments, retrieval arms, questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def error_outcomes(errors: DataFrame, results: DataFrame, findings: DataFrame) -> DataFrame:
    """What judge and gate did about each injected error: error_id, kind, outcome.

    errors (error_id, scheme_id, kind, field, op, value), results (scheme_id, failed), findings (scheme_id, ordinal,
    predicate_field, retired_field, op, value, decision). The first finding that names the error's field decides:
    flagged if the gate did not accept it, corrected if it brings a dropped predicate back as it was, else a wrong fix.
    """
    named = findings.withColumn("field", F.explode(F.array_distinct(F.array_compact(F.array("predicate_field", "retired_field")))))
    first = named.groupBy("scheme_id", "field").agg(F.min_by(F.struct("predicate_field", "op", "value", "decision"), "ordinal").alias("f"))
    joined = errors.join(results.select("scheme_id", "failed"), "scheme_id", "left").join(first, ["scheme_id", "field"], "left")
    right = (F.col("kind") == "dropped_predicate") & (F.col("f.predicate_field") == F.col("field")) & F.col("f.op").eqNullSafe(F.col("op")) & F.col("f.value").eqNullSafe(F.col("value"))
    outcome = F.when(F.col("failed").isNull(), "not_run").when(F.col("failed"), "judge_failed").when(F.col("f").isNull(), "missed").when(F.col("f.decision") != "auto_accept", "flagged").when(right, "corrected").otherwise("wrong_fix")
    return joined.select("error_id", "kind", outcome.alias("outcome"))


def clean_control(decisions: DataFrame) -> DataFrame:
    """decisions on rules without error (group, accepted): n, false accepts and false defers' share by group."""
    return decisions.groupBy("group").agg(F.count("*").alias("n"), F.avg(F.col("accepted").cast("int")).alias("false_accept"), F.avg((~F.col("accepted")).cast("int")).alias("false_defer"))


def produced_rules(missing: DataFrame, share: float = 0.66) -> DataFrame:
    """missing rules (kind, agreement): how many there are of each kind, and how many most samples still produced."""
    return missing.groupBy("kind").agg(F.count("*").alias("removed"), F.count_if(F.col("agreement") >= share).alias("produced"))


def compared(recorded: DataFrame, again: DataFrame, corrected: DataFrame, key: list[str], figure: str, within: float = 5e-5) -> DataFrame:
    """Figures as recorded, as reproduced and as corrected: adds reproduces (within a tolerance) and change."""
    side = lambda df, name: df.select(*key, F.col(figure).alias(name))
    rows = side(recorded, "recorded").join(side(again, "reproduced"), key, "left").join(side(corrected, "corrected"), key, "left")
    return rows.withColumn("reproduces", F.coalesce(F.abs(F.col("recorded") - F.col("reproduced")) < within, F.lit(False))).withColumn("change", F.col("corrected") - F.col("recorded"))


def paired_configurations(one: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs (scheme_id, valid, reason, figure) of two configurations: those valid in both side by side, the others with why.

    A scheme that one side has no run of is "not run"; the second side's own reason comes first.
    """
    a, b = (df.select("scheme_id", F.col("valid").alias(f"v{i}"), F.col("reason").alias(f"r{i}"), F.col("figure").alias(f"f{i}")) for i, df in enumerate((one, other)))
    rows = a.join(b, "scheme_id", "full")
    both = F.coalesce("v0", F.lit(False)) & F.coalesce("v1", F.lit(False))
    why = F.when(F.col("v1") == F.lit(False), F.col("r1")).when(~F.coalesce("v0", F.lit(False)), F.coalesce("r0", F.lit("no first run"))).otherwise("second not run")
    return rows.where(both).select("scheme_id", F.col("f0").alias("first"), F.col("f1").alias("second")), rows.where(~both).select("scheme_id", why.alias("reason"))


def amendment_scorecard(checks: DataFrame) -> DataFrame:
    """checks (scheme_id, name, role, ok, value, expected): by check and role how many valid samples are as expected."""
    valid = F.col("ok")
    values = F.array_join(F.array_sort(F.collect_set(F.when(valid, F.col("value")))), ",")
    return checks.groupBy("scheme_id", "name", "role").agg(F.count_if(valid & (F.col("value") == F.col("expected"))).alias("as_expected"), F.count_if(valid).alias("valid_samples"), F.count_if(~valid).alias("failed_samples"), values.alias("values"))


def retrieval_arms(findings: DataFrame, targets: DataFrame) -> DataFrame:
    """findings (scheme_id, arm, ordinal, category, retired_field, decision) against each scheme's retired field (target).

    By scheme and arm: findings, temporal ones, whether one names the target, and the gate's decision on the first.
    """
    joined = findings.join(targets.select("scheme_id", "target"), "scheme_id", "left")
    temporal = F.col("category") == "temporal_supersession"
    hit = temporal & F.col("retired_field").eqNullSafe(F.col("target"))
    return joined.groupBy("scheme_id", "arm").agg(F.count("*").alias("findings"), F.count_if(temporal).alias("temporal_findings"), F.max(hit).alias("found"), F.min_by(F.when(hit, F.col("decision")), F.when(hit, F.col("ordinal"))).alias("gate_on_it"))


def batch_report(scores: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A row for each configuration and scheme, and a total with a null scheme: tp, fp, fn, f1, agreement, runs, valid.

    scores (configuration, scheme_id, tp, fp, fn) of valid drafts, outcomes (configuration, scheme_id, valid,
    agreement) of all: an invalid draft counts in the share of valid ones and in nothing else.
    """
    joined = outcomes.join(scores, ["configuration", "scheme_id"], "left")
    sums = joined.rollup("configuration", "scheme_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], F.avg(F.expr("CASE WHEN valid THEN agreement END")).alias("agreement"), F.count("*").alias("runs"), F.count_if("valid").alias("valid"))
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return sums.where("configuration IS NOT NULL").withColumn("f1", f1)


def verdict_differences(one: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Rows of two drafts' verdicts (*key, verdict) that differ, also where only one has a verdict."""
    a, b = one.select(*key, F.col("verdict").alias("first")), other.select(*key, F.col("verdict").alias("second"))
    return a.join(b, key, "full").where(~F.col("first").eqNullSafe(F.col("second")))


def differing(pairs: DataFrame) -> DataFrame:
    """verdict_differences() of verdicts g and d that stand side by side already, so that nothing is joined."""
    # a filter on an exploded array stays above it: else Catalyst would evaluate both rule sets again in the filter
    key = [c for c in pairs.columns if c not in ("g", "d")]
    rows = pairs.select(*key, F.explode(F.array(F.array("g", "d"))).alias("_v"))
    first, second = F.get("_v", F.lit(0)), F.get("_v", F.lit(1))
    return rows.where(~first.eqNullSafe(second)).select(*key, first.alias("first"), second.alias("second"))


def questions_saved(asked: DataFrame, fields: DataFrame) -> DataFrame:
    """asked (scheme_id, profile_id, field) against all fields of each scheme (scheme_id, field): by scheme how many
    questions a verdict took on average, of how many, and the share that was not asked."""
    total = fields.groupBy("scheme_id").agg(F.count_distinct("field").alias("fields"))
    per = asked.groupBy("scheme_id", "profile_id").agg(F.count_distinct("field").alias("n")).groupBy("scheme_id").agg(F.count("*").alias("verdicts"), F.avg("n").alias("questions"))
    return per.join(total, "scheme_id").withColumn("saved", 1 - F.col("questions") / F.col("fields"))


def first_wins(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """The first row of each key, by a partial aggregate."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(ordinal)).alias("r")).select(*key, "r.*")


def with_tier(gold: DataFrame, catalogue: DataFrame, columns: list[str]) -> DataFrame:
    """Gold rows and catalogue rows in one table with their tier; a catalogue row of a gold slug is left out."""
    rest = catalogue.join(gold.select("slug"), "slug", "left_anti")
    return gold.select(*columns, F.lit("verified").alias("tier")).unionByName(rest.select(*columns, F.lit("catalogue").alias("tier")))


def enriched(rows: DataFrame, records: DataFrame, sections: DataFrame, key: str, value: str) -> DataFrame:
    """rows with a value looked up by key: the matched record's, else the document section's, else none; and its source."""
    a, b = records.select(key, F.col(value).alias("_a")), sections.select(key, F.col(value).alias("_b"))
    out = rows.join(a, key, "left").join(b, key, "left")
    filled = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.col(c))
    return out.withColumn(value, F.coalesce(filled("_a"), filled("_b"))).withColumn("origin", F.when(filled("_a").isNotNull(), "record").when(filled("_b").isNotNull(), "document").otherwise("none")).drop("_a", "_b")


def translated(keys: DataFrame, translations: DataFrame, lang: str) -> DataFrame:
    """keys (key, source) with text: the translation into lang if it is of this very source and keeps its placeholders, else the source."""
    marks = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\{[a-z_]*\})"), F.lit(1))))
    t = translations.where(F.col("lang") == lang).select("key", F.col("source").alias("_s"), F.col("text").alias("_t"))
    good = (F.col("_s") == F.col("source")) & (F.col("_t") != "") & (marks(F.col("_t")) == marks(F.col("source")))
    return keys.join(t, "key", "left").withColumn("text", F.when(F.coalesce(good, F.lit(False)), F.col("_t")).otherwise(F.col("source"))).drop("_s", "_t")


def ontology_coverage(fields: DataFrame, ontology: DataFrame) -> DataFrame:
    """fields (field) against ontology (name, aliases): canonical name and how it was found (canonical, alias, proposed)."""
    names = ontology.select(F.col("name").alias("field"), F.col("name").alias("canonical"), F.lit(0).alias("rank"))
    other = ontology.select(F.explode("aliases").alias("field"), F.col("name").alias("canonical"), F.lit(1).alias("rank"))
    best = names.unionByName(other).groupBy("field").agg(F.min(F.struct("rank", "canonical")).alias("b"))
    return fields.join(best, "field", "left").select("field", F.col("b.canonical").alias("canonical"), F.when(F.col("b").isNull(), "proposed").when(F.col("b.rank") == 0, "canonical").otherwise("alias").alias("found"))


def novel_fields(flat: DataFrame, ontology: DataFrame, generated: DataFrame) -> DataFrame:
    """Rule fields without a question in the ontology or among the generated ones: scheme_id, field, answer_type, family.

    The type is that of the first rule that reads the field; family tells that only exclusions over the family read it.
    """
    known = ontology.select(F.col("name").alias("field")).unionByName(generated.select("field")).distinct()
    own = (F.col("location") == "inclusion") | (F.col("quantifier") == "self") | (F.col("except_scope") == "applicant")
    kind = F.min_by(F.col("value.kind"), "ordinal")
    rows = flat.join(known, "field", "left_anti").groupBy("scheme_id", "field").agg(kind.alias("k"), (~F.max(F.coalesce(own, F.lit(False)))).alias("family"))
    return rows.select("scheme_id", "field", F.when(F.col("k") == "bool", "boolean").when(F.col("k") == "num", "number").otherwise("text").alias("answer_type"), "family")


def question_text(fields: DataFrame, ontology: DataFrame) -> DataFrame:
    """fields (field, family) with the question to ask: the ontology's, else a general one; of family members in the third person."""
    joined = fields.join(ontology.select(F.col("name").alias("field"), "question"), "field", "left")
    words = F.replace(F.col("field"), F.lit("_"), F.lit(" "))
    q = F.coalesce("question", F.concat(F.lit("What is your "), words, F.lit("?")))
    they = q
    for pattern, new in ((r"\b([Aa])re you\b", "$1re they"), (r"\b([Dd])o you\b", "$1o they"), (r"\b([Yy])our\b", "their"), (r"\b([Yy])ou\b", "they")):
        they = F.regexp_replace(they, pattern, new)
    return joined.select("field", "family", F.when(F.col("family"), they).otherwise(q).alias("question"))


def review_order(rows: DataFrame) -> DataFrame:
    """Review sheet rows with their place: those for a translator first, then translated ones, then the rest, by key."""
    from pyspark.sql.window import Window

    rank = F.when(F.col("by_hand"), 0).when(F.coalesce("text", F.lit("")) != "", 1).otherwise(2)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(rank, "key")))


def between(text: Column, start: str, end: str) -> Column:
    """The text from one marker up to another, trimmed; null if either is missing."""
    i = F.call_function("locate", F.lit(start), text, F.lit(1))
    j = F.call_function("locate", F.lit(end), text, i + len(start))
    return F.when((i > 0) & (j > 0), F.regexp_replace(F.substr(text, i, j - i), r"^\s+|\s+$", ""))


def dated_text(texts: DataFrame, by: list[str]) -> DataFrame:
    """Texts (date, text) of each group as one, in order of date."""
    return texts.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
