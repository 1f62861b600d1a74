"""Sources and sinks: rule sets, profiles, corpora, catalogues, runs, ledgers, review sheets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.functions.mojibake import fix_mojibake
from verdictlake.functions.values import DDL
from verdictlake.operators.retrieval import coverage
from verdictlake.plans.rulesets import RuleSet, flat_table, from_dict, to_dict

CATALOGUE = "slug STRING, scheme_name STRING, description STRING, eligibility_text STRING, benefits_text STRING, application_process_text STRING, official_link STRING, ministry_or_state STRING, sections_found ARRAY<STRING>, parse_warning STRING"
TEXT_FIELDS = ("scheme_name", "description", "eligibility_text", "benefits_text", "application_process_text")


def read_rule_sets(spark: SparkSession, path: str) -> list[RuleSet]:
    """Rule sets of a folder of JSON files, a file each. They are configuration, so they come to the driver."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").collect()
    return sorted((from_dict(json.loads(r["value"])) for r in rows), key=lambda r: (r.scheme_id, r.version))


def write_rule_sets(spark: SparkSession, rule_sets: list[RuleSet], path: str) -> None:
    """A line of canonical JSON for each rule set; refuses rules that do not read back as they are."""
    lines = []
    for r in rule_sets:
        line = json.dumps(to_dict(r), sort_keys=True, ensure_ascii=False)
        if from_dict(json.loads(line)) != r:
            raise ValueError(f"{r.scheme_id} does not read back as it is")
        lines.append((line,))
    spark.createDataFrame(lines, "value STRING").coalesce(1).write.text(path)


def read_rule_table(spark: SparkSession, path: str) -> DataFrame:
    return flat_table(spark, read_rule_sets(spark, path))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile suites ({profile_id: {"self": {...}, "family_members": [...]}}) as suite, profile_id, members.

    Keys that start with an underscore are dropped. A key with a null value is a fact; an absent key is not.
    """
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("suite"), F.parse_json("value").alias("v"))
    one = whole.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("profile_id"), F.col("value").alias("p"))).where("profile_id NOT LIKE '\\\\_%'")
    return one.selectExpr("suite", "profile_id", "to_json(p) AS json").withColumn("members", _members(F.col("json"))).drop("json")


def _members(json_text):
    """members of a profile's JSON text, by schemas that keep every value as text."""
    from pyspark.sql.types import StringType

    own = F.get_json_object(json_text, "$.self")
    family = F.from_json(F.get_json_object(json_text, "$.family_members"), "ARRAY<STRING>")
    records = F.concat(F.array(F.coalesce(own, F.lit("{}"))), F.coalesce(family, F.array().cast("array<string>")))
    raw = StringType().simpleString()

    def facts(record):
        keys = F.coalesce(F.json_object_keys(record), F.array().cast(f"array<{raw}>"))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), tag(F.parse_json(record), k).alias("value"))))

    def tag(record, key):
        v = F.variant_get(record, F.concat(F.lit("$['"), key, F.lit("']")), "variant")
        kind = F.when(F.is_variant_null(v), "null").when(F.schema_of_variant(v) == "BOOLEAN", "bool").when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL)"), "num").when(F.schema_of_variant(v).startswith("ARRAY"), "list").otherwise("str")
        num = F.when(kind == "bool", F.try_variant_get(v, "$", "boolean").cast("int").cast("double")).when(kind == "num", F.try_variant_get(v, "$", "double"))
        text = F.when(kind == "str", F.try_variant_get(v, "$", "string"))
        items = F.when(kind == "list", F.transform(F.try_variant_get(v, "$", "array<string>"), lambda s: F.concat(F.when(s.try_cast("double").isNotNull(), "n:").otherwise("s:"), F.coalesce(s.try_cast("double").cast("string"), s))))
        return F.struct(kind.alias("kind"), num.alias("num"), text.alias("str"), items.alias("arr")).cast(DDL)

    return F.transform(records, lambda r, i: F.struct(i.alias("ix"), facts(r).alias("facts")))


def read_corpus(spark: SparkSession, path: str, least: int = 20) -> DataFrame:
    """Text files of `key: value` lines, a blank line and a body: doc fields as a map, chunk_index and text of each paragraph.

    Paragraphs under `least` characters are dropped before they are numbered.
    """
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("source_path"), F.split("value", r"\r?\n[ \t]*\r?\n", 2).alias("p"))
    header = F.map_from_entries(F.transform(F.filter(F.split(F.get("p", F.lit(0)), r"\r?\n"), lambda s: F.contains(s, F.lit(":"))), lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("key"), F.trim(F.regexp_replace(s, "^[^:]*:", "")).alias("value"))))
    chunks = F.filter(F.transform(F.split(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"\n\s*\n"), F.trim), lambda s: F.length(s) >= least)
    rows = whole.select("source_path", header.alias("header"), F.posexplode(chunks).alias("chunk_index", "text"))
    return rows.withColumn("effective_date", F.try_to_date(F.try_element_at("header", F.lit("effective_date"))))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Line JSON, blank lines skipped, damaged text repaired."""
    return fix_mojibake(spark.read.schema(CATALOGUE).json(path).where("slug IS NOT NULL"), *TEXT_FIELDS)


def write_catalogue(df: DataFrame, path: str) -> DataFrame:
    """Writes line JSON; returns the summary of what was written, one row."""
    df.write.json(path)
    return coverage(df.sparkSession.read.schema(df.schema).json(path), [c for c in TEXT_FIELDS if c in df.columns])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run files, each with the first draft that it has: gated, repaired, draft; and the file's name."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    pick = [F.get_json_object("value", f"$.{k}") for k in ("gated", "repaired", "draft")]
    stage = F.when(pick[0].isNotNull(), "gated").when(pick[1].isNotNull(), "repaired").when(pick[2].isNotNull(), "draft")
    return df.select(F.col("_metadata.file_name").alias("file"), F.get_json_object("value", "$.scheme_id").alias("scheme_id"), stage.alias("stage"), F.coalesce(*pick).alias("rules"))


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def export_review(rows: DataFrame, earlier: DataFrame | None, path: str) -> None:
    """A CSV sheet of key, source, text, its files in order of key; earlier answers stay, and rows whose text has changed since are marked."""
    if earlier is not None:
        old = earlier.select("key", F.col("text").alias("_old"), "answer", "fix")
        rows = rows.join(old, "key", "left").withColumn("changed", F.col("_old").isNotNull() & (F.col("_old") != F.col("text"))).drop("_old")
    else:
        rows = rows.withColumn("answer", F.lit(None).cast("string")).withColumn("fix", F.lit(None).cast("string")).withColumn("changed", F.lit(False))
    rows.orderBy("key").write.option("header", True).csv(path)


def import_review(spark: SparkSession, path: str, current: DataFrame) -> DataFrame:
    """current (key, text, status) with a sheet's answers: OK marks as reviewed, FIX takes the new text; outcome says why not."""
    sheet = spark.read.option("header", True).csv(path).select("key", F.col("text").alias("_seen"), F.upper(F.trim("answer")).alias("_a"), "fix")
    df = current.join(sheet, "key", "left")
    fixed = (F.col("_a") == "FIX") & (F.trim("fix") != "")
    outcome = F.when(F.col("_a").isNull(), "no answer").when(F.col("_seen") != F.col("text"), "text changed since").when(F.col("_a") == "OK", "reviewed").when(fixed, "fixed").otherwise("not understood")
    df = df.withColumn("outcome", outcome)
    return df.withColumn("text", F.when(F.col("outcome") == "fixed", F.col("fix")).otherwise(F.col("text"))).withColumn("status", F.when(F.col("outcome").isin("reviewed", "fixed"), "reviewed").otherwise(F.col("status"))).drop("_seen", "_a", "fix")
