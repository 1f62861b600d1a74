"""Structural scoring of drafts against gold by multiset pairing, and scoring by outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

IDENTITY = ["scheme_id", "location", "about"]
KEY = ["parent_field", "field", "op", "value_repr", "quantifier", "except_scope"]


def _keyed(flat: DataFrame) -> DataFrame:
    """Adds about (the field that predicates are paired on) and mk (what makes two of them the same)."""
    about = F.when(F.col("location") == "exception", F.col("parent_field")).otherwise(F.col("field"))
    return flat.withColumn("about", about).withColumn("mk", F.to_json(F.struct(*KEY), {"ignoreNullFields": "false"}))


def paired(gold: DataFrame, draft: DataFrame) -> DataFrame:
    """Pairs flat predicates within scheme, location and field, as multisets: equal ones first, the rest in order.

    Columns: scheme_id, location, about, gold_cat, draft_cat, gold_field, draft_field, label (exact,
    present_but_wrong, missing, hallucinated). Rows of gold and draft carry ordinal, their order in the rule set.
    """
    same = Window.partitionBy(*IDENTITY, "mk").orderBy("ordinal")
    g = _keyed(gold).withColumn("rn", F.row_number().over(same)).select(*IDENTITY, "mk", "rn", F.col("ordinal").alias("go"), F.col("cat").alias("gold_cat"), F.col("field").alias("gold_field"))
    d = _keyed(draft).withColumn("rn", F.row_number().over(same)).select(*IDENTITY, "mk", "rn", F.col("ordinal").alias("do"), F.col("cat").alias("draft_cat"), F.col("field").alias("draft_field"))
    once = g.join(d, [*IDENTITY, "mk", "rn"], "full")
    exact = once.where("go IS NOT NULL AND do IS NOT NULL").withColumn("label", F.lit("exact"))
    left = once.where("do IS NULL").withColumn("rn", F.row_number().over(Window.partitionBy(*IDENTITY).orderBy("go"))).select(*IDENTITY, "rn", "go", "gold_cat", "gold_field")
    right = once.where("go IS NULL").withColumn("rn", F.row_number().over(Window.partitionBy(*IDENTITY).orderBy("do"))).select(*IDENTITY, "rn", "do", "draft_cat", "draft_field")
    rest = left.join(right, [*IDENTITY, "rn"], "full").withColumn("label", F.when(F.col("do").isNull(), "missing").when(F.col("go").isNull(), "hallucinated").otherwise("present_but_wrong"))
    columns = [*IDENTITY, "gold_cat", "draft_cat", "gold_field", "draft_field", "label"]
    return exact.select(*columns).unionByName(rest.select(*columns))


def rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; an empty denominator gives 1, and F1 is 0 if both are 0."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def structural_score(pairs: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 by scheme and category, with a row of category __overall__ for each scheme.

    A wrong value is a miss of the gold category and a false hit of it; a hallucination is charged to the draft's.
    """
    cat = F.coalesce("gold_cat", "draft_cat")
    counted = pairs.select("scheme_id", cat.alias("category"), (F.col("label") == "exact").cast("long").alias("tp"), F.col("label").isin("present_but_wrong", "hallucinated").cast("long").alias("fp"), F.col("label").isin("present_but_wrong", "missing").cast("long").alias("fn"))
    sums = counted.rollup("scheme_id", "category").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).where("scheme_id IS NOT NULL")
    p, r, f = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select("scheme_id", F.coalesce("category", F.lit("__overall__")).alias("category"), "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"))


def batch_score(scores: DataFrame, validity: DataFrame) -> DataFrame:
    """One row: micro tp, fp, fn, precision, recall, f1 over schemes, and the share of valid drafts (scheme_id, valid)."""
    micro = scores.where("category = '__overall__'").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p, r, f = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    share = validity.agg(F.try_divide(F.count_if("valid"), F.count("*")).alias("schema_validity"))
    return micro.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1")).join(share)


def category_disagreements(pairs: DataFrame) -> DataFrame:
    return pairs.where("gold_cat <> draft_cat").select("scheme_id", "location", "about", "gold_cat", "draft_cat")


def disagreement(gold: Column, draft: Column) -> Column:
    """Null where verdicts agree; undetermined verdicts are never false positives or negatives."""
    return F.when(gold == draft, None).when((draft == "eligible") & (gold == "ineligible"), "false_positive_eligible").when((gold == "eligible") & (draft == "ineligible"), "false_negative_eligible").otherwise("other_mismatch")


def outcome_equivalence(gold: DataFrame, draft: DataFrame, by: list[str]) -> DataFrame:
    """Rates over profiles of two verdict tables (profile_id, *by, verdict); null rates where there is no profile."""
    joined = gold.select("profile_id", *by, F.col("verdict").alias("g")).join(draft.select("profile_id", *by, F.col("verdict").alias("d")), ["profile_id", *by])
    return outcome_rates(joined, by)


def outcome_rates(pairs: DataFrame, by: list[str]) -> DataFrame:
    """outcome_equivalence() of verdicts g and d that stand side by side already."""
    kind = disagreement(F.col("g"), F.col("d"))
    share = lambda name: F.try_divide(F.count_if(kind == name), F.count("*"))
    return pairs.groupBy(*by).agg(F.count("*").alias("n_profiles"), F.try_divide(F.count_if(kind.isNull()), F.count("*")).alias("agreement"), share("false_positive_eligible").alias("false_eligible"), share("false_negative_eligible").alias("false_not_eligible"), share("other_mismatch").alias("other"))


def relation(baseline: Column, evaluated: Column) -> Column:
    """How a direct answer relates to the evaluator's verdict: 6 classes."""
    return (
        F.when(baseline == evaluated, "agree")
        .when((baseline == "eligible") & (evaluated == "ineligible"), "false_positive_vs_ineligible")
        .when((baseline == "eligible") & (evaluated == "undetermined_missing_facts"), "false_positive_vs_undetermined")
        .when((baseline == "ineligible") & (evaluated == "eligible"), "false_negative")
        .when((baseline == "undetermined_missing_facts") & evaluated.isin("eligible", "ineligible"), "over_cautious")
        .otherwise("other")
    )


def direct_answer_report(answers: DataFrame) -> DataFrame:
    """answers (scheme_id, baseline_verdict, evaluator_verdict): n, agreement, harmful positives and counts by relation."""
    r = answers.withColumn("r", relation(F.col("baseline_verdict"), F.col("evaluator_verdict")))
    n = lambda *names: F.count_if(F.col("r").isin(*names))
    names = ("agree", "false_positive_vs_ineligible", "false_positive_vs_undetermined", "false_negative", "over_cautious", "other")
    return r.groupBy("scheme_id").agg(F.count("*").alias("n"), (n("agree") / F.count("*")).alias("agreement"), (n(*names[1:3]) / F.count("*")).alias("harmful_positive"), *[n(x).alias(x) for x in names])


def silent_defaults(answers: DataFrame) -> DataFrame:
    """Among undetermined verdicts: n and the shares answered eligible, ineligible and unsure."""
    return answers.where("evaluator_verdict = 'undetermined_missing_facts'").groupBy("scheme_id").agg(F.count("*").alias("n"), F.avg((F.col("baseline_verdict") == "eligible").cast("int")).alias("said_eligible"), F.avg((F.col("baseline_verdict") == "ineligible").cast("int")).alias("said_ineligible"), F.avg((F.col("baseline_verdict") == "undetermined_missing_facts").cast("int")).alias("unsure"))


def pairwise_agreement(verdicts: DataFrame) -> DataFrame:
    """verdicts (scheme_id, profile_id, verdict): agreement of every unordered pair of drafts over their profiles."""
    a, b = verdicts.alias("a"), verdicts.alias("b")
    joined = a.join(b, (F.col("a.profile_id") == F.col("b.profile_id")) & (F.col("a.scheme_id") < F.col("b.scheme_id")))
    return joined.groupBy(F.col("a.scheme_id").alias("first"), F.col("b.scheme_id").alias("second")).agg(F.count("*").alias("n"), F.avg(F.col("a.verdict").eqNullSafe(F.col("b.verdict")).cast("int")).alias("agreement"))


def side_by_side_agreement(wide: DataFrame, drafts: dict[str, str]) -> DataFrame:
    """pairwise_agreement() of drafts whose verdicts are columns of one row a profile (scheme_id to column): no join."""
    pairs = [(a, b) for a in sorted(drafts) for b in sorted(drafts) if a < b]
    rows = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(drafts[a]).eqNullSafe(F.col(drafts[b])).cast("int").alias("same")) for a, b in pairs])
    return wide.select(F.inline(rows)).groupBy("first", "second").agg(F.count("*").alias("n"), F.avg("same").alias("agreement"))


def scalar_fields(gold: DataFrame, draft: DataFrame, fields: list[str]) -> DataFrame:
    """Match rate of scalar fields of rule sets joined on scheme_id; two nulls match."""
    joined = gold.alias("g").join(draft.alias("d"), "scheme_id")
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"g.{f}").eqNullSafe(F.col(f"d.{f}")).alias("same")) for f in fields])).alias("x")
    return joined.select(rows).groupBy("x.field").agg(F.count("*").alias("n"), F.avg(F.col("x.same").cast("int")).alias("match_rate"))


def multiset_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows added and removed by a change, as multisets, with column change."""
    return after.exceptAll(before).withColumn("change", F.lit("added")).unionByName(before.exceptAll(after).withColumn("change", F.lit("removed")))
