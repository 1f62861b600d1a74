"""Confidence analytics: self-consistency, calibration error, threshold tables, rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def agreement(samples: DataFrame, key: list[str]) -> DataFrame:
    """samples (scheme_id, sample, *key): share of a scheme's samples that hold the identical predicate; two samples at least."""
    total = samples.groupBy("scheme_id").agg(F.count_distinct("sample").alias("samples")).where("samples >= 2")
    return samples.groupBy("scheme_id", *key).agg(F.count_distinct("sample").alias("hits")).join(total, "scheme_id").withColumn("agreement", F.col("hits") / F.col("samples"))


def multiset_agreement(samples: DataFrame, gold: DataFrame, key: list[str], drafts: DataFrame | None = None) -> DataFrame:
    """scheme_id, sample, *key, n, correct, agreement: how often each valid sample of a scheme has a predicate.

    samples (scheme_id, sample, *key), a row an occurrence; gold (scheme_id, *key) likewise. agreement is the share of
    the scheme's samples that have the predicate at all; of a sample's n copies as many are correct as gold has, at
    most n. Schemes with fewer than two samples are left out. drafts (scheme_id, sample) lists the valid samples, so
    that one without a predicate counts; without it they are those of `samples`. Keys match null-safe.

    Occurrences are counted before the exchange; one aggregate by predicate then has all samples and gold side by side.
    """
    by = ["scheme_id", *key]
    both = samples.select(*by, F.struct("sample").alias("_s")).unionByName(gold.select(*by, F.lit(None).cast(samples.select(F.struct("sample")).schema[0].dataType).alias("_s")))
    counted = both.groupBy(*by, "_s").agg(F.count("*").alias("_n"))
    sides = counted.groupBy(*by).agg(F.collect_list(F.when(F.col("_s").isNotNull(), F.struct("_s", "_n"))).alias("_found"), F.coalesce(F.max(F.when(F.col("_s").isNull(), F.col("_n"))), F.lit(0)).alias("_gold"))
    valid = (samples if drafts is None else drafts).select("scheme_id", "sample").distinct().groupBy("scheme_id").agg(F.count("*").alias("_k")).where("_k >= 2")
    rows = sides.join(valid, "scheme_id").select(*by, "_gold", (F.size("_found") / F.col("_k")).alias("agreement"), F.explode("_found").alias("_f"))
    return rows.select("scheme_id", F.col("_f._s.sample").alias("sample"), *key, F.col("_f._n").alias("n"), F.least(F.col("_f._n"), F.col("_gold")).alias("correct"), "agreement")


def multiset_summary(found: DataFrame) -> DataFrame:
    """By scheme of multiset_agreement(): predicates over all samples, and by predicate mean agreement, unanimous share and precision."""
    total = F.sum("n")
    return found.groupBy("scheme_id").agg(total.alias("predicates"), (F.sum(F.col("n") * F.col("agreement")) / total).alias("mean_agreement"), (F.sum(F.when(F.col("agreement") == 1, F.col("n")).otherwise(0)) / total).alias("unanimous"), (F.sum("correct") / total).alias("precision"))


def ece_bins(points: DataFrame, bins: list[tuple[float, float]], confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """Reliability over closed bins that may leave gaps: lo, hi, n, accuracy, mean_confidence, gap and the bin's share of ECE.

    A point in a gap counts in the total and in no bin; empty bins stay with n = 0.
    """
    spark = points.sparkSession
    edges = spark.createDataFrame([(float(a), float(b)) for a, b in bins], "lo DOUBLE, hi DOUBLE")
    inside = F.array(*[F.when((F.col(confidence) >= a) & (F.col(confidence) <= b), F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi"))) for a, b in bins])
    per = points.select(F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("b"), confidence, correct).groupBy("b.lo", "b.hi").agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"), F.avg(confidence).alias("mean_confidence"))
    total = points.agg(F.count("*").alias("total"))
    joined = F.broadcast(edges).join(per, ["lo", "hi"], "left").join(F.broadcast(total))
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence"))
    return joined.select("lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "accuracy", "mean_confidence", F.coalesce(F.try_divide(F.col("n"), F.col("total")) * gap, F.lit(0.0)).alias("ece_part"))


def ece_distinct(points: DataFrame, confidence: str = "confidence", correct: str = "correct", digits: int = 2) -> DataFrame:
    """One row: ECE over the distinct rounded confidences, and how many points it has."""
    per = points.groupBy(F.round(confidence, digits).alias("c")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("a"))
    return per.agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))), F.sum("n")).alias("ece"))


def threshold_table(points: DataFrame, limits: list[float], score: str, wrong: str) -> DataFrame:
    """Flagging points whose score is at most a limit (+ 1e-9): flagged, true_flags, precision, recall by limit. One pass."""
    spark = points.sparkSession
    flagged = [F.count_if(F.col(score) <= x + 1e-9).alias(f"f{i}") for i, x in enumerate(limits)]
    true = [F.count_if((F.col(score) <= x + 1e-9) & F.col(wrong)).alias(f"t{i}") for i, x in enumerate(limits)]
    sums = points.agg(F.count_if(F.col(wrong)).alias("w"), *flagged, *true)
    rows = F.array(*[F.struct(F.lit(float(x)).alias("limit"), F.col(f"f{i}").alias("flagged"), F.col(f"t{i}").alias("true_flags"), F.try_divide(F.col(f"t{i}"), F.col(f"f{i}")).alias("precision"), F.try_divide(F.col(f"t{i}"), F.col("w")).alias("recall")) for i, x in enumerate(limits)])
    return sums.select(F.explode(rows).alias("r")).select("r.*") if limits else spark.createDataFrame([], "limit DOUBLE, flagged LONG, true_flags LONG, precision DOUBLE, recall DOUBLE")


def average_ranks(points: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Adds the average rank of a value within groups: ranks come from counts of values, so ties need no large sort."""
    counts = points.groupBy(*by, value).agg(F.count("*").alias("_ties"))
    before = F.sum("_ties").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranked = counts.withColumn(name, F.coalesce(before, F.lit(0)) + (F.col("_ties") + 1) / 2).drop("_ties")
    return points.join(ranked, [*by, value])


def spearman(points: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Spearman's correlation by group, rounded to 3; null for fewer than 3 points or no variance."""
    ranked = average_ranks(average_ranks(points, x, by, "_rx"), y, by, "_ry")
    rho = F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry"))  # corr() fails without variance
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.round(rho, 3)).alias("rho"))


def gate_outcomes(decisions: DataFrame) -> DataFrame:
    """decisions (group, kind, outcome): counts of outcomes by group and kind; groups are never pooled."""
    return decisions.groupBy("group", "kind", "outcome").agg(F.count("*").alias("n"))


def sample_agreement(found: DataFrame) -> DataFrame:
    """By scheme of agreement(): predicates, share in every sample, mean agreement."""
    return found.groupBy("scheme_id").agg(F.count("*").alias("predicates"), F.avg((F.col("hits") == F.col("samples")).cast("int")).alias("unanimous"), F.avg("agreement").alias("mean_agreement"))


def attribution(candidates: DataFrame, added: Column) -> DataFrame:
    """Marks the first `added` copies of each candidate key (scheme_id, key, ordinal) as errors."""
    place = F.row_number().over(Window.partitionBy("scheme_id", "key").orderBy("ordinal"))
    return candidates.withColumn("is_error", place <= added)
