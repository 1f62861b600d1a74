"""The gate on proposed rule changes, applying accepted ones, and labelled error injection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdictlake.functions.text import quote_is_verbatim, value_is_grounded
from verdictlake.sources.shared import frozen

BASE_THRESHOLD, TEMPORAL_THRESHOLD, RAISED_BY = 0.7, 0.9, 0.1


def target_key(category: Column, retired_field: Column, predicate_field: Column) -> Column:
    """What a finding claims, to match it with another sample's findings; null if it proposes nothing."""
    return F.when((category == "temporal_supersession") & retired_field.isNotNull(), F.concat(F.lit("supersedes:"), retired_field)).when((category == "preambular_implied_fact") & predicate_field.isNotNull(), F.concat(F.lit("predicate:"), predicate_field))


def reproduced(findings: DataFrame, samples: DataFrame) -> DataFrame:
    """Adds consistent: null without samples of the finding's scheme or without a key, else whether a sample has its key.

    findings (scheme_id, key, ...), samples (scheme_id, key).
    """
    have = samples.select("scheme_id").distinct().withColumn("_have", F.lit(True))
    keys = samples.select("scheme_id", "key").where("key IS NOT NULL").distinct().withColumn("_hit", F.lit(True))
    joined = findings.join(have, "scheme_id", "left").join(keys, ["scheme_id", "key"], "left")
    return joined.withColumn("consistent", F.when(F.col("_have").isNotNull() & F.col("key").isNotNull(), F.col("_hit").isNotNull())).drop("_have", "_hit")


def decide(findings: DataFrame) -> DataFrame:
    """Adds decision, reasons, threshold, quote_verbatim and value_grounded to findings joined with their document.

    Needs category, quote, confidence, document, retired (a tagged value or null), consistent (or null).
    """
    temporal = F.col("category") == "temporal_supersession"
    df = findings.withColumn("quote_verbatim", quote_is_verbatim(F.col("quote"), F.col("document")))
    df = df.withColumn("value_grounded", F.when(temporal & F.col("retired").isNotNull(), value_is_grounded(F.col("retired"), F.col("document"))))
    base = F.when(temporal, TEMPORAL_THRESHOLD).otherwise(BASE_THRESHOLD)
    df = df.withColumn("threshold", F.when(F.col("consistent") == F.lit(False), F.round(base + RAISED_BY, 2)).otherwise(base))
    hard = ~F.col("quote_verbatim") | F.coalesce(temporal & ~F.col("value_grounded"), F.lit(False))
    below = F.col("confidence") < F.col("threshold")
    reasons = F.array_compact(F.array(F.when(~F.col("quote_verbatim"), "quote not verbatim"), F.when(F.col("value_grounded") == F.lit(False), "value not grounded"), F.when(F.col("consistent") == F.lit(False), "not reproduced"), F.when(below, "below threshold")))
    df = df.withColumn("decision", F.when(hard | below, "defer_to_review").otherwise("auto_accept"))
    return df.withColumn("reasons", F.when((F.size(reasons) == 0), F.array(F.lit("quote verbatim, above threshold"))).otherwise(reasons))


def apply_accepted(rules: DataFrame, decided: DataFrame) -> DataFrame:
    """Flat rules with the accepted findings' predicates after the last ordinal of their scheme.

    decided: decision, scheme_id, ordinal and a struct `predicate` with the columns of flat rules but ordinal.
    """
    last = rules.groupBy("scheme_id").agg(F.max("ordinal").alias("_last"))
    new = decided.where("decision = 'auto_accept' AND predicate IS NOT NULL").join(last, "scheme_id")
    place = F.row_number().over(Window.partitionBy("scheme_id").orderBy("ordinal"))
    fields = [c for c in rules.columns if c not in ("scheme_id", "ordinal")]
    new = new.select("scheme_id", (F.col("_last") + place).cast("int").alias("ordinal"), *[F.col(f"predicate.{c}").alias(c) for c in fields])
    return rules.unionByName(new.select(*rules.columns))


def mutation_candidates(flat: DataFrame) -> DataFrame:
    """Errors that can be injected into flat rules: (scheme_id, ordinal, kind)."""
    numeric, inclusion = F.col("value.kind") == "num", F.col("location") == "inclusion"
    kinds = F.array_compact(F.array(
        F.when(numeric & F.col("op").isin("<", "<=", ">", ">="), "threshold"),
        F.when(F.col("op").isin("==", "!=", "<", "<=", ">", ">="), "operator"),
        F.when(F.col("value.kind") == "bool", "value"),
        F.when(F.col("has_except"), "exception_dropped"),
        F.when(F.col("location") == "exclusion", "exclusion_dropped"),
        F.when(inclusion, "predicate_dropped"),
    ))
    return flat.select("scheme_id", "ordinal", F.explode(kinds).alias("kind"))


def draw_mutations(candidates: DataFrame, per_variant: int = 3, seed: int = 1) -> DataFrame:
    """Adds variant and place: kinds take turns, one error a predicate, the order drawn by a hash of the seed."""
    h = F.xxhash64(F.lit(seed), "scheme_id", "ordinal", "kind")
    one = candidates.withColumn("_h", h).withColumn("_r", F.row_number().over(Window.partitionBy("scheme_id", "ordinal").orderBy("_h"))).where("_r = 1")
    turn = one.withColumn("_t", F.row_number().over(Window.partitionBy("scheme_id", "kind").orderBy("_h")))
    order = F.row_number().over(Window.partitionBy("scheme_id").orderBy("_t", "kind", "_h")) - 1
    return turn.withColumn("_o", order).select("scheme_id", "ordinal", "kind", F.floor(F.col("_o") / per_variant).cast("int").alias("variant"), (F.col("_o") % per_variant).cast("int").alias("place"))


#: Kinds of errors, in the order of their cycle.
ERROR_KINDS = ("threshold", "operator", "value", "exception_dropped", "exclusion_dropped", "predicate_dropped")


def balanced_errors(candidates: DataFrame, errors: int | None = None, per_variant: int = 3, seed: int = 1) -> DataFrame:
    """scheme_id, ordinal, kind, turn, variant, place: `errors` of the candidates (scheme_id, ordinal, kind), all without it.

    A predicate gets one error at most, its kind drawn by a checksum of the seed. A scheme's kinds take turns, in a
    cycle that begins at another kind for each scheme, so kinds are balanced over all. Schemes with the fewest errors
    come first: every scheme has its error number n before one gets the next, as far as it has predicates; the last turn
    goes to the schemes of the least checksums. A scheme's errors fill variants of `per_variant`.
    """
    drawn = lambda *parts: F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    h = drawn("scheme_id", "ordinal", "kind")
    one = candidates.withColumn("_h", h).withColumn("_r", F.row_number().over(Window.partitionBy("scheme_id", "ordinal").orderBy("_h"))).where("_r = 1")
    one = one.withColumn("_t", F.row_number().over(Window.partitionBy("scheme_id", "kind").orderBy("_h"))).withColumn("_s", drawn("scheme_id"))
    start = F.expr("position(substr(_s, 1, 1), '0123456789abcdef')")
    cycle = (F.array_position(F.lit(list(ERROR_KINDS)), F.col("kind")) - 1 + start) % len(ERROR_KINDS)
    turns = one.withColumn("turn", F.row_number().over(Window.partitionBy("scheme_id").orderBy("_t", cycle, "_h")) - 1)
    if errors is not None:
        full, left = -1, errors
        for row in turns.groupBy("turn").agg(F.count("*").alias("n")).orderBy("turn").collect():  # as many rows as a scheme has predicates
            if row["n"] > left:
                break
            full, left = row["turn"], left - row["n"]
        last = _least(turns.where(F.col("turn") == full + 1), "_s", ["_s", "scheme_id"], left)
        turns = turns.where(F.col("turn") <= full).unionByName(last)
    return turns.select("scheme_id", "ordinal", "kind", "turn", F.floor(F.col("turn") / per_variant).cast("int").alias("variant"), (F.col("turn") % per_variant).cast("int").alias("place"))


def _least(rows: DataFrame, digest: str, order: list[str], n: int, few: int = 10_000) -> DataFrame:
    """The n first rows by `order`, which begins with a hexadecimal digest: no task holds more than about `few` of them.

    Rows are counted by the digest's first digits until the one beginning that n falls into has few rows; what comes
    before it is taken whole, and only its rows are ordered.
    """
    prefix, width = "", 3
    while True:
        inside = rows.where(F.col(digest).startswith(prefix))
        counts = inside.groupBy(F.substring(digest, 1, len(prefix) + width).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # at most 4,096 rows
        for row in counts:
            if row["n"] > n or (row["n"] == n and row["p"] == prefix):
                break
            n -= row["n"]
        else:
            return rows.where(F.col(digest).startswith(prefix) | (F.col(digest) < prefix))
        same, prefix = row["p"] == prefix, row["p"]
        if row["n"] <= few or same:
            place = F.row_number().over(Window.partitionBy(F.substring(digest, 1, len(prefix))).orderBy(*order))
            chosen = rows.where(F.col(digest).startswith(prefix)).withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
            return rows.where(F.col(digest) < prefix).unionByName(chosen)


def valid_errors(flat: DataFrame, errors: int | None = None, per_variant: int = 3, seed: int = 1) -> DataFrame:
    """balanced_errors() of flat rules such that every variant is still a rule set: some inclusion leaf stays.

    The last dropped predicate of a variant without any is taken from the candidates and all is drawn anew, until every
    variant is valid; each round takes away at least one candidate. Other kinds keep a rule set valid: operators stay
    within the vocabulary, and an exception goes with its exclusion.
    """
    candidates = frozen(mutation_candidates(flat).repartition("scheme_id"))  # a small file would else be one task
    leaves = flat.where("location = 'inclusion'").groupBy("scheme_id").agg(F.count("*").alias("_leaves"))
    while True:
        drawn = frozen(balanced_errors(candidates, errors, per_variant, seed))
        gone = drawn.where("kind = 'predicate_dropped'").groupBy("scheme_id", "variant").agg(F.count("*").alias("_n"), F.max_by("ordinal", "place").alias("ordinal")).join(leaves, "scheme_id").where("_n >= _leaves")
        if gone.isEmpty():
            return drawn
        candidates = frozen(candidates.join(gone.select("scheme_id", "ordinal", F.lit("predicate_dropped").alias("kind")), ["scheme_id", "ordinal", "kind"], "left_anti"))


def mutate(flat: DataFrame, drawn: DataFrame) -> DataFrame:
    """Flat rules of each variant with its errors in place; dropped predicates leave, and exceptions with their exclusions or by themselves (path + ".except")."""
    variants = drawn.select("scheme_id", "variant").distinct()
    base = flat.join(variants, "scheme_id").join(drawn.select("scheme_id", "ordinal", "variant", "kind"), ["scheme_id", "ordinal", "variant"], "left")
    flipped = F.create_map(*[F.lit(x) for pair in (("==", "!="), ("!=", "=="), ("<", ">"), ("<=", ">="), (">", "<"), (">=", "<=")) for x in pair])
    value = F.col("value")
    num = F.when(F.col("kind") == "threshold", F.bround(value["num"] * 1.5, 2)).when(F.col("kind") == "value", 1 - value["num"]).otherwise(value["num"])
    out = base.withColumn("op", F.when(F.col("kind") == "operator", flipped[F.col("op")]).otherwise(F.col("op"))).withColumn("value", value.withField("num", num)).withColumn("has_except", F.col("has_except") & (F.coalesce("kind", F.lit("")) != "exception_dropped"))
    out = out.withColumn("value_repr", F.when(F.col("kind").isin("threshold", "value"), F.col("value.num").cast("string")).otherwise(F.col("value_repr")))
    spared = out.where("kind IN ('exclusion_dropped', 'exception_dropped')").select("scheme_id", "variant", F.concat("path", F.lit(".except")).alias("path"))
    return out.where(F.coalesce("kind", F.lit("")).isin("exclusion_dropped", "predicate_dropped") == F.lit(False)).drop("kind").join(spared, ["scheme_id", "variant", "path"], "left_anti").select(*[c for c in out.columns if c != "kind"])


def review_queue(findings: DataFrame) -> DataFrame:
    """The latest run's findings of each scheme, gated anew: findings as for decide(), with scheme_id and run."""
    last = findings.groupBy("scheme_id").agg(F.max("run").alias("run"))
    return decide(findings.join(last, ["scheme_id", "run"], "left_semi")).withColumn("queue", F.when(F.col("decision") == "auto_accept", "accepted").otherwise("deferred"))


def repair_passes(passes: DataFrame, most: int = 2) -> DataFrame:
    """passes (scheme_id, pass, findings, applied) up to where the loop ends: no finding, none applied, or `most` passes.

    Adds stop, why the pass was the last one, null if another follows.
    """
    before = Window.partitionBy("scheme_id").orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)
    goes_on = (F.col("findings") > 0) & (F.col("applied") > 0)
    kept = passes.withColumn("_ended", F.coalesce(F.max((~goes_on).cast("int")).over(before), F.lit(0))).where((F.col("_ended") == 0) & (F.col("pass") <= most)).drop("_ended")
    return kept.withColumn("stop", F.when(F.col("findings") == 0, "no findings").when(F.col("applied") == 0, "none applied").when(F.col("pass") == most, "pass limit"))


def apply_findings(rules: DataFrame, findings: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Flat rules with what accepted findings propose, and a log: scheme_id, ordinal, applied, why.

    findings (scheme_id, ordinal, confidence, action, field, op, value_repr, quantifier): action add_predicate puts a
    leaf under the inclusion's AND, add_exclusion an exclusion after the last one; others change no predicate. rules
    (scheme_id, ordinal, path, location, field, op, value_repr, quantifier). An inclusion that is no AND becomes the
    first part of one, so its paths move one level down.
    """
    does = F.col("action").isin("add_predicate", "add_exclusion")
    why = F.when(F.col("confidence") < threshold, "below threshold").when(~F.coalesce(does, F.lit(False)), "no predicate proposed")
    log = findings.select("scheme_id", "ordinal", why.isNull().alias("applied"), F.coalesce(why, F.lit("applied")).alias("why"))
    new = findings.where(why.isNull())
    state = rules.groupBy("scheme_id").agg(F.max("ordinal").alias("_last"), F.count_if((F.col("location") == "inclusion") & ~F.col("path").startswith("inclusion.and[")).alias("_bare"), F.max(F.when(F.col("location") == "inclusion", F.regexp_extract("path", r"^inclusion\.and\[(\d+)\]", 1).try_cast("int"))).alias("_and"), F.count_if(F.col("location") == "exclusion").alias("_ex"))
    wraps = new.where("action = 'add_predicate'").select("scheme_id").distinct().withColumn("_adds", F.lit(True))
    moved = rules.join(state.select("scheme_id", "_bare"), "scheme_id", "left").join(wraps, "scheme_id", "left")
    deeper = (F.col("location") == "inclusion") & F.coalesce("_adds", F.lit(False)) & (F.col("_bare") > 0)
    moved = moved.withColumn("path", F.when(deeper, F.concat(F.lit("inclusion.and[0]"), F.substring("path", len("inclusion") + 1, 1 << 30))).otherwise(F.col("path"))).select(*rules.columns)
    place = F.row_number().over(Window.partitionBy("scheme_id").orderBy("ordinal"))
    nth = F.row_number().over(Window.partitionBy("scheme_id", "action").orderBy("ordinal"))
    base = F.when(F.col("_bare") > 0, F.lit(0)).otherwise(F.coalesce("_and", F.lit(-1)))
    path = F.when(F.col("action") == "add_predicate", F.concat(F.lit("inclusion.and["), base + nth, F.lit("]"))).otherwise(F.concat(F.lit("exclusions["), F.col("_ex") + nth - 1, F.lit("]")))
    added = new.join(state, "scheme_id").select("scheme_id", (F.col("_last") + place).cast("int").alias("ordinal"), path.alias("path"), F.when(F.col("action") == "add_predicate", "inclusion").otherwise("exclusion").alias("location"), "field", "op", "value_repr", F.when(F.col("action") == "add_exclusion", F.coalesce("quantifier", F.lit("self"))).alias("quantifier"))
    return moved.unionByName(added.select(*rules.columns)), log


def apply_temporal(history: DataFrame, findings: DataFrame, threshold: float = BASE_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Version histories with what accepted findings say about the latest version, and a log: scheme_id, ordinal, applied, why.

    history (scheme_id, version, valid_from, valid_to, supersedes_version, retired_field, quote), valid_to exclusive or
    null. findings (scheme_id, ordinal, confidence, category, rule_version, retired_field, quote, new_valid_from): one
    of temporal_supersession that names a retired field sets what the scheme's latest version supersedes, and with
    new_valid_from its start; of several of a scheme the last does. Then intervals close: a version ends, at the
    latest, where the next one begins. Below the threshold, of another category or without a retired field nothing is
    applied. Versions are ordered by valid_from (nulls first) and version.
    """
    says = (F.col("category") == "temporal_supersession") & F.col("retired_field").isNotNull()
    latest = history.groupBy("scheme_id").agg(F.max(F.struct("valid_from", "version")).alias("_latest"))
    why = F.when(~F.coalesce(F.col("confidence") >= threshold, F.lit(False)), "below threshold").when(~F.coalesce(says, F.lit(False)), "nothing retired").when(F.col("_latest").isNull(), "no version")
    judged = findings.join(latest, "scheme_id", "left").withColumn("_why", why)
    log = judged.select("scheme_id", "ordinal", F.col("_why").isNull().alias("applied"), F.coalesce("_why", F.lit("applied")).alias("why"))
    last = judged.where("_why IS NULL").groupBy("scheme_id", "_latest").agg(F.max_by(F.struct("rule_version", "retired_field", "quote", "new_valid_from"), "ordinal").alias("_f"))
    upsert = last.select("scheme_id", F.col("_latest.version").alias("version"), "_f")
    rows = history.join(upsert, ["scheme_id", "version"], "left")
    hit = F.col("_f").isNotNull()
    rows = rows.select(
        "scheme_id", "version", F.coalesce("_f.new_valid_from", "valid_from").alias("valid_from"), "valid_to",
        *[F.when(hit, F.col(f"_f.{new}")).otherwise(F.col(old)).alias(old) for old, new in (("supersedes_version", "rule_version"), ("retired_field", "retired_field"), ("quote", "quote"))],
    )
    following = F.lead("valid_from").over(Window.partitionBy("scheme_id").orderBy(F.asc_nulls_first("valid_from"), "version"))
    return rows.withColumn("valid_to", F.least("valid_to", following)), log


def chain_faults(history: DataFrame, documents: DataFrame) -> DataFrame:
    """scheme_id, version, faults of each version that claims to supersede another, as names of the checks that fail.

    `unknown`: the scheme has no version of that name; `order`: it does not begin earlier, so no chain that passes is a
    ring; `fabricated`: the quote it rests on is not in the scheme's document (scheme_id, document), or there is none.
    """
    claims = history.where("supersedes_version IS NOT NULL").select("scheme_id", "version", "valid_from", "supersedes_version", "quote")
    named = history.groupBy("scheme_id", F.col("version").alias("supersedes_version")).agg(F.min("valid_from").alias("_since"), F.lit(True).alias("_there"))
    found = claims.join(named, ["scheme_id", "supersedes_version"], "left").join(documents.select("scheme_id", "document"), "scheme_id", "left")
    earlier = F.coalesce(F.col("_since") < F.col("valid_from"), F.col("_since").isNull() & F.col("valid_from").isNotNull())
    checks = {"unknown": F.col("_there").isNull(), "order": F.col("_there").isNotNull() & ~earlier, "fabricated": ~F.coalesce(quote_is_verbatim(F.col("quote"), F.col("document")), F.lit(False))}
    return found.select("scheme_id", "version", F.array_compact(F.array(*[F.when(bad, name) for name, bad in checks.items()])).alias("faults"))


def selected_as_of(history: DataFrame, date: Column) -> DataFrame:
    """The version of each scheme that is in force on a date: begun (null: always) and not ended."""
    begun, ended = F.coalesce(F.col("valid_from") <= date, F.lit(True)), F.coalesce(F.col("valid_to") <= date, F.lit(False))
    return history.where(begun & ~ended)
