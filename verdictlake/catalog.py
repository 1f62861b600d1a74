"""The library's queries over the driver tables, by name, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.catalog_base import QUERIES, SQL, query  # noqa: F401
from verdictlake.catalog_base import read as _read
from verdictlake.functions import text as T
from verdictlake.functions.mojibake import fix_mojibake
from verdictlake.functions.values import of_num
from verdictlake.operators import confidence, evaluate, gate, ledger, retrieval, scoring
from verdictlake.plans import household as H

# The household's members and facts, and H1 to H3, in SQL: counts of true and unknown members for each exclusion.
_COUNTS = """lines AS (
  SELECT l_orderkey AS k,
    count(*) FILTER (WHERE l_partkey % 13 <> 0 AND l_returnflag = 'R' AND l_discount < 0.09) AS x1_true,
    count(*) FILTER (WHERE l_partkey % 13 = 0 AND l_discount < 0.09) AS x1_open,
    count(*) FILTER (WHERE l_suppkey % 17 <> 0 AND l_quantity >= 45) AS x2_low,
    count(*) FILTER (WHERE l_suppkey % 17 = 0) AS x2_open,
    count(*) FILTER (WHERE NOT l_tax > 0.06) AS x3_false
  FROM lineitem GROUP BY l_orderkey),
base AS (
  SELECT o_orderkey AS profile_id, o_totalprice AS price, o_orderstatus AS status,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority IN ('1-URGENT', '2-HIGH') END AS urgent,
    CASE WHEN coalesce(x1_true, 0) > 0 THEN TRUE WHEN coalesce(x1_open, 0) > 0 THEN NULL ELSE FALSE END AS x1,
    coalesce(x2_low, 0) AS low, coalesce(x2_low, 0) + coalesce(x2_open, 0) AS high,
    coalesce(x3_false, 0) = 0 AS x3
  FROM orders LEFT JOIN lines ON o_orderkey = k),
tested AS (
  SELECT *, CASE WHEN low >= 2 THEN TRUE WHEN high < 2 THEN FALSE END AS many FROM base),
outcome AS (
  SELECT profile_id, 'H1' AS scheme_id, (price >= 50000 AND (urgent OR status = 'F')) AS inc, (x1 OR (many AND NOT price >= 300000) OR x3) AS exc FROM tested
  UNION ALL
  SELECT profile_id, 'H2', (price >= 50000 AND (urgent OR status <> 'F')), (x1 OR (many AND NOT price >= 450000)) FROM tested
  UNION ALL
  SELECT profile_id, 'H3', (price >= 50000 AND (urgent OR status = 'F')), (x1 OR x3) FROM tested),
verdicts AS (
  SELECT profile_id, scheme_id, CASE WHEN exc THEN 'ineligible' WHEN NOT inc THEN 'ineligible' WHEN inc AND NOT exc THEN 'eligible' ELSE 'undetermined_missing_facts' END AS verdict, inc, exc FROM outcome)
"""


@query(f"WITH {_COUNTS} SELECT profile_id, scheme_id, verdict, inc AS included, exc AS excluded FROM verdicts WHERE scheme_id = 'H1'")
def eval_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.evaluate(H.profiles(spark, sf_dir), [H.H1]).select("profile_id", "scheme_id", "verdict", "included", "excluded")


@query(f"WITH {_COUNTS} SELECT profile_id, scheme_id, verdict FROM verdicts")
def eval_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rule sets in one scan of the profiles."""
    return evaluate.evaluate(H.profiles(spark, sf_dir), [H.H1, H.H2, H.H3]).select("profile_id", "scheme_id", "verdict")


@query(f"WITH {_COUNTS} SELECT profile_id, low, high, many AS result FROM tested")
def eval_count_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.count_ranges(H.profiles(spark, sf_dir), H.H1.exclusions[1])


@query("""
WITH m AS (
  SELECT o_orderkey AS profile_id, 0 AS member, FALSE AS returned, CASE WHEN o_orderkey % 11 <> 0 THEN 0.0 END AS discount, 0.0 AS quantity, 1.0 AS tax FROM orders
  UNION ALL
  SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 13 <> 0 THEN l_returnflag = 'R' END, l_discount, CASE WHEN l_suppkey % 17 <> 0 THEN l_quantity END, l_tax FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
SELECT o_orderkey AS profile_id, 'inclusion.and[0]' AS path, 0 AS member, o_totalprice >= 50000 AS result FROM orders
UNION ALL SELECT o_orderkey, 'inclusion.and[1].or[0]', 0, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority IN ('1-URGENT', '2-HIGH') END FROM orders
UNION ALL SELECT o_orderkey, 'inclusion.and[1].or[1]', 0, o_orderstatus = 'F' FROM orders
UNION ALL SELECT profile_id, 'exclusions[0]', member, returned FROM m
UNION ALL SELECT profile_id, 'exclusions[0].except', member, discount >= 0.09 FROM m
UNION ALL SELECT profile_id, 'exclusions[1]', member, quantity >= 45 FROM m
UNION ALL SELECT o_orderkey, 'exclusions[1].except', 0, o_totalprice >= 300000 FROM orders
UNION ALL SELECT profile_id, 'exclusions[2]', member, tax > 0.06 FROM m""")
def eval_trace_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.trace(H.profiles(spark, sf_dir), H.H1, ("path", "member", "result")).drop("scheme_id")


@query(f"WITH {_COUNTS} SELECT profile_id, 1 AS exclusion FROM tested WHERE many AND price >= 300000")
def waived_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.waived(H.profiles(spark, sf_dir), H.H1)


@query(f"""WITH {_COUNTS},
open AS (SELECT t.* FROM tested t JOIN verdicts v ON v.profile_id = t.profile_id AND v.scheme_id = 'H1' AND v.verdict = 'undetermined_missing_facts')
SELECT profile_id, 'inclusion.and[1].or[0]' AS path, 0 AS member, 'priority' AS field FROM open WHERE (price >= 50000 AND (urgent OR status = 'F')) IS NULL AND urgent IS NULL AND (urgent OR status = 'F') IS NULL
UNION ALL
SELECT profile_id, 'exclusions[0]', l_linenumber, 'returned' FROM open JOIN lineitem ON l_orderkey = profile_id WHERE x1 IS NULL AND l_partkey % 13 = 0 AND l_discount < 0.09
UNION ALL
SELECT profile_id, 'exclusions[1]', l_linenumber, 'quantity' FROM open JOIN lineitem ON l_orderkey = profile_id WHERE (many AND NOT price >= 300000) IS NULL AND l_suppkey % 17 = 0""")
def missing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.missing_facts(H.profiles(spark, sf_dir), H.H1).select("profile_id", "path", "member", "field")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.evaluate(H.profiles(spark, sf_dir), [H.H1, H.H2, H.H3]).select("profile_id", "scheme_id", "verdict")


@query(f"""WITH {_COUNTS}, b AS (SELECT g.profile_id, g.verdict AS g, d.verdict AS d FROM verdicts g JOIN verdicts d ON g.profile_id = d.profile_id AND g.scheme_id = 'H1' AND d.scheme_id = 'H2')
SELECT count(*) AS n_profiles, avg((g = d)::INT) AS agreement, avg((g = 'ineligible' AND d = 'eligible')::INT) AS false_eligible, avg((g = 'eligible' AND d = 'ineligible')::INT) AS false_not_eligible,
  avg((g <> d AND NOT (g = 'ineligible' AND d = 'eligible') AND NOT (g = 'eligible' AND d = 'ineligible'))::INT) AS other FROM b""")
def outcome_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.outcome_rates(evaluate.verdict_pairs(H.profiles(spark, sf_dir), H.H1, H.H2), [])


@query(f"""WITH {_COUNTS} SELECT a.scheme_id AS first, b.scheme_id AS second, count(*) AS n, avg((a.verdict = b.verdict)::INT) AS agreement
FROM verdicts a JOIN verdicts b ON a.profile_id = b.profile_id AND a.scheme_id < b.scheme_id GROUP BY ALL""")
def pairwise_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = [H.H1, H.H2, H.H3]
    wide = evaluate.outcomes(H.profiles(spark, sf_dir), drafts)
    return scoring.side_by_side_agreement(wide, {r.scheme_id: f"verdict_{k}" for k, r in enumerate(drafts)})


# Segments' rules from the customers: each market segment's gold rules are the balances of its first nations, its draft's another year's.
_SEGMENT_RULES = """g AS (SELECT c_mktsegment AS scheme_id, 'nation' || c_nationkey AS field, CASE WHEN c_nationkey % 2 = 0 THEN 'economic' ELSE 'demographic' END AS cat, '>=' AS op, CAST(floor(max(c_acctbal) / 1000) AS BIGINT) AS v FROM customer GROUP BY ALL),
d AS (SELECT c_mktsegment AS scheme_id, 'nation' || c_nationkey AS field, CASE WHEN c_nationkey % 2 = 0 THEN 'economic' ELSE 'demographic' END AS cat, '>=' AS op, CAST(floor(max(c_acctbal) / 1000) AS BIGINT) AS v FROM customer WHERE c_custkey % 3 <> 0 GROUP BY ALL)"""


def _segment_rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customers = _read(spark, sf_dir, "customer")

    def flat(rows: DataFrame) -> DataFrame:
        one = rows.groupBy(F.col("c_mktsegment").alias("scheme_id"), "c_nationkey").agg(F.floor(F.max("c_acctbal") / 1000).alias("v"))
        none = F.lit(None).cast("string")
        return one.select("scheme_id", F.col("c_nationkey").alias("ordinal"), F.lit("inclusion").alias("location"), F.concat(F.lit("nation"), F.col("c_nationkey")).alias("field"), F.when(F.col("c_nationkey") % 2 == 0, "economic").otherwise("demographic").alias("cat"), F.lit(">=").alias("op"), F.col("v").cast("string").alias("value_repr"), none.alias("quantifier"), none.alias("parent_field"), none.alias("except_scope"))

    return flat(customers), flat(customers.where("c_custkey % 3 <> 0"))


@query(f"""WITH {_SEGMENT_RULES}, p AS (SELECT coalesce(g.scheme_id, d.scheme_id) AS scheme_id, coalesce(g.cat, d.cat) AS cat, g.v AS gv, d.v AS dv FROM g FULL JOIN d ON g.scheme_id = d.scheme_id AND g.field = d.field),
s AS (SELECT scheme_id, cat AS category, sum((gv IS NOT DISTINCT FROM dv)::INT)::BIGINT AS tp, sum((dv IS NOT NULL AND gv IS DISTINCT FROM dv)::INT)::BIGINT AS fp, sum((gv IS NOT NULL AND gv IS DISTINCT FROM dv)::INT)::BIGINT AS fn FROM p GROUP BY GROUPING SETS ((scheme_id, cat), (scheme_id))),
r AS (SELECT scheme_id, coalesce(category, '__overall__') AS category, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM s)
SELECT scheme_id, category, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1 FROM r""")
def structural_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.structural_score(scoring.paired(*_segment_rules(spark, sf_dir)))


@query(f"""WITH {_SEGMENT_RULES}, a AS (SELECT scheme_id, field, v::VARCHAR AS value FROM g), b AS (SELECT scheme_id, field, v::VARCHAR AS value FROM d)
SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""")
def rule_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, draft = (t.select("scheme_id", "field", F.col("value_repr").alias("value")) for t in _segment_rules(spark, sf_dir))
    return scoring.multiset_diff(gold, draft)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: confidence from their length, correct if of good quality."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(_read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "n_chars", "quality", "toxic", ((F.col("n_chars") % 1000) / 1000.0).alias("confidence"), (F.col("quality") == 1).alias("correct"))


_POINTS = "points AS (SELECT doc_id, lang, n_chars, quality, toxic, (n_chars % 1000) / 1000.0::DOUBLE AS confidence, quality = 1 AS correct FROM documents JOIN labels USING (doc_id))"
_BINS = [(0.0, 0.33), (0.34, 0.66), (0.67, 1.0)]


@query(f"""WITH {_POINTS}, bins(lo, hi) AS (VALUES (0.0::DOUBLE, 0.33::DOUBLE), (0.34, 0.66), (0.67, 1.0)), total AS (SELECT count(*) AS t FROM points)
SELECT lo, hi, count(doc_id) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(confidence), 6) AS mean_confidence, round(coalesce(count(doc_id) / any_value(t) * abs(avg(correct::INT) - avg(confidence)), 0), 6) AS ece_part
FROM bins CROSS JOIN total LEFT JOIN points ON confidence BETWEEN lo AND hi GROUP BY lo, hi""")
def ece_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = confidence.ece_bins(_points(spark, sf_dir), _BINS)
    return out.select("lo", "hi", "n", F.round("accuracy", 6).alias("accuracy"), F.round("mean_confidence", 6).alias("mean_confidence"), F.round("ece_part", 6).alias("ece_part"))


@query(f"WITH {_POINTS}, per AS (SELECT floor((n_chars % 1000 + 5) / 10) / 100 AS c, count(*) AS n, avg(correct::INT) AS a FROM points GROUP BY 1) SELECT sum(n)::BIGINT AS n, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM per")
def ece_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).withColumn("confidence", F.floor((F.col("n_chars") % 1000 + 5) / 10) / 100)
    return confidence.ece_distinct(points).select("n", F.round("ece", 6).alias("ece"))


@query(f"""WITH {_POINTS}, limits(x) AS (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0))
SELECT x AS "limit", count(*) FILTER (WHERE confidence <= x + 1e-9) AS flagged, count(*) FILTER (WHERE confidence <= x + 1e-9 AND NOT correct) AS true_flags,
  round(count(*) FILTER (WHERE confidence <= x + 1e-9 AND NOT correct) / nullif(count(*) FILTER (WHERE confidence <= x + 1e-9), 0), 6) AS precision,
  round(count(*) FILTER (WHERE confidence <= x + 1e-9 AND NOT correct) / nullif(count(*) FILTER (WHERE NOT correct), 0), 6) AS recall FROM limits CROSS JOIN points GROUP BY x""")
def threshold_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).withColumn("wrong", ~F.col("correct"))
    out = confidence.threshold_table(points, [0.0, 0.25, 0.5, 0.75, 1.0], "confidence", "wrong")
    return out.select("limit", "flagged", "true_flags", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"""WITH {_POINTS}, r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY lang ORDER BY quality) + (count(*) OVER (PARTITION BY lang, quality) - 1) / 2.0 AS ry FROM points)
SELECT lang, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN round(corr(rx, ry), 3) END AS rho FROM r GROUP BY lang""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidence.spearman(_points(spark, sf_dir), "n_chars", "quality", ["lang"])


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW), 4) AS tokens_24h FROM events")
def rolling_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return ledger.rolling_sum(events, "ts", "value", ledger.DAY, ["user_id"], "s").select("event_id", F.round("s", 4).alias("tokens_24h"))


@query("SELECT event_id, round(sum(value) OVER (ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW), 3) AS tokens_24h FROM events")
def rolling_24h_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all users: days as partitions, not one window over the table."""
    events = _read(spark, sf_dir, "events").select("event_id", "ts", "value")
    return ledger.rolling_sum_by_day(events, "ts", "value", "s").select("event_id", F.round("s", 3).alias("tokens_24h"))


@query("SELECT event_id, sum(1) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '59.999999 seconds' PRECEDING AND CURRENT ROW)::BIGINT AS calls_60s FROM events")
def rolling_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("event_id", "user_id", "ts").withColumn("one", F.lit(1))
    return ledger.rolling_sum(events, "ts", "one", 60, ["user_id"], "calls_60s").select("event_id", "calls_60s")


@query("""WITH n AS (SELECT max(ts) AS now FROM events), r AS (SELECT ts, sum(value) AS v FROM events, n WHERE ts > now - INTERVAL '24 hours' AND ts <= now GROUP BY ts),
t AS (SELECT sum(v) AS total FROM r), g AS (SELECT ts, sum(v) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS gone FROM r)
SELECT round(CASE WHEN total + 500 <= total * 0.75 THEN 0 ELSE coalesce((SELECT date_diff('microseconds', now, min(ts) + INTERVAL '24 hours') / 1000000.0 FROM g, n WHERE total - gone + 500 <= total * 0.75 GROUP BY now), 86400) END, 3) AS wait_seconds FROM t""")
def headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Until three quarters of the last day's usage hold 500 more."""
    events = _read(spark, sf_dir, "events").select("ts", "value")
    now = events.agg(F.max("ts")).first()[0]
    total = events.where((F.col("ts") > F.lit(now) - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= F.lit(now))).agg(F.sum("value")).first()[0] or 0.0
    return ledger.seconds_to_headroom(events, "ts", "value", F.lit(now), total * 0.75, 500.0).select(F.round("wait_seconds", 3).alias("wait_seconds"))


@query("SELECT user_id, event_type, max(struct_pack(ts := ts, event_id := event_id)).event_id AS event_id FROM events GROUP BY ALL")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return ledger.latest(events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) WHERE used <= 8000")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return ledger.pack_context(docs, ["source"], [F.col("n_chars"), F.col("doc_id")], "n_chars", 8000).select("source", "doc_id", "used")


@query("SELECT count(*) AS n, avg((coalesce(trim(text), '') <> '')::INT) AS text_filled, avg((coalesce(trim(lang), '') <> '')::INT) AS lang_filled, avg((coalesce(trim(source), '') <> '')::INT) AS source_filled FROM documents")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.coverage(_read(spark, sf_dir, "documents"), ["text", "lang", "source"])


@query("SELECT source, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, quantile_cont(n_chars, 0.5) AS median, count(*) FILTER (WHERE len(string_split_regex(trim(text), '\\s+')) < 200) AS thin FROM documents GROUP BY source")
def source_adequacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.source_adequacy(_read(spark, sf_dir, "documents"), ["source"], "text", "n_chars")


def _case(words: dict[str, list[str]]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category FROM documents WHERE regexp_matches(lower(source || ' ' || text), '{'|'.join(w)}')" for c, w in words.items())


@query(_case(T.CATEGORY_WORDS))
def category_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(T.categories_of(F.col("source"), F.col("text"))).alias("category"))


@query("SELECT p_partkey AS id, p_name AS name, (SELECT count(*) FROM part WHERE contains(lower(p_name), 'a')) AS total FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40")
def browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return retrieval.browse(parts, "A", offset=40, limit=20).select("id", "name", "total")


@query("SELECT s_suppkey, CASE WHEN n_name IN (SELECT n_name FROM nation WHERE n_regionkey < 2) THEN 'state_or_ut' WHEN n_name <> '' THEN 'central_or_other' ELSE 'unknown' END AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def region_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation")
    known = [r[0] for r in nation.where("n_regionkey < 2").select("n_name").distinct().collect()]  # a closed list of names, as in the reference semantics
    label = _read(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"), "left")  # nation: 25 rows
    return label.select("s_suppkey", retrieval.classify_region(F.col("n_name"), known).alias("region"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return docs.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_QUOTE = "regexp_replace(translate(lower({0}), '‑–—', '---'), '\\s+', ' ', 'g')"


@query(f"""WITH b AS (SELECT item_id, trim({_QUOTE.format('text')}) AS q FROM benchmark), d AS (SELECT doc_id, trim({_QUOTE.format('text')}) AS t FROM documents)
SELECT item_id, doc_id FROM b JOIN d ON contains(t, q) WHERE len(string_split(q, ' ')) >= 3""")
def quote_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that quote a benchmark item of three words or more; they meet on the item's rarest inner word."""
    clean = lambda c: T.normalize_quote(F.col(c))
    items = _read(spark, sf_dir, "benchmark").select("item_id", clean("text").alias("q"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", clean("text").alias("t"))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("t", " "))).alias("w"))
    split = F.split("q", " ")  # a quote may begin and end within a word, so its first and last do not count
    inner = items.where(F.size(split) >= 3).select("item_id", F.explode(F.array_distinct(F.slice(split, 2, F.size(split) - 2))).alias("w"))
    asked = inner.select("w").distinct()
    seen = words.join(asked, "w")
    frequency = seen.groupBy("w").agg(F.count("*").alias("df"))
    rarest = inner.join(frequency, "w", "left").groupBy("item_id").agg(F.min_by("w", F.struct(F.coalesce("df", F.lit(0)), "w")).alias("w"))
    pairs = seen.join(rarest, "w").select("item_id", "doc_id")
    return pairs.join(docs, "doc_id").join(items, "item_id").where(T.quote_is_verbatim(F.col("q"), F.col("t"))).select("item_id", "doc_id")


@query(f"""WITH d AS (SELECT doc_id, n_chars % 100 AS v, {_QUOTE.format('text')} AS t FROM documents), w(n, word) AS (VALUES {', '.join(f"({n}, '{w}')" for w, n in T.NUMBER_WORDS.items())})
SELECT doc_id, contains(t, v::VARCHAR) OR contains(replace(t, ',', ''), v::VARCHAR) OR coalesce(contains(t, word), FALSE) AS grounded FROM d LEFT JOIN w ON n = v""")
def value_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", T.value_is_grounded(of_num(F.col("n_chars") % 100), F.col("text")).alias("grounded"))


@query(f"""WITH f AS (SELECT doc_id, doc_id % 2 = 0 AS temporal, (doc_id % 41) / 40.0 AS confidence, n_chars % 100 AS v, {_QUOTE.format('text')} AS t, {_QUOTE.format("CASE WHEN doc_id % 5 = 0 THEN 'no such words in any text' ELSE substring(text, 1, 40) END")} AS q FROM documents),
g AS (SELECT *, contains(t, trim(q)) AS verbatim, CASE WHEN temporal THEN contains(t, v::VARCHAR) OR contains(replace(t, ',', ''), v::VARCHAR) OR coalesce(contains(t, word), FALSE) END AS grounded, CASE WHEN temporal THEN 0.9 ELSE 0.7 END AS threshold
FROM f LEFT JOIN (VALUES {', '.join(f"({n}, '{w}')" for w, n in T.NUMBER_WORDS.items())}) w(n, word) ON n = v)
SELECT doc_id, verbatim AS quote_verbatim, grounded AS value_grounded, CASE WHEN NOT verbatim OR grounded = FALSE OR confidence < threshold THEN 'defer_to_review' ELSE 'auto_accept' END AS decision FROM g""")
def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    quote = F.when(F.col("doc_id") % 5 == 0, "no such words in any text").otherwise(F.substring("text", 1, 40))
    findings = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "temporal_supersession").otherwise("preambular_implied_fact").alias("category"), quote.alias("quote"), ((F.col("doc_id") % 41) / 40.0).alias("confidence"), F.col("text").alias("document"), of_num(F.col("n_chars") % 100).alias("retired"), F.lit(None).cast("boolean").alias("consistent"))
    return gate.decide(findings).select("doc_id", "quote_verbatim", "value_grounded", "decision")


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]') THEN 'ur' WHEN regexp_matches(text, '[\\x{0B80}-\\x{0BFF}]') THEN 'ta' WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}]') THEN 'deva'
WHEN len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w IN (%s))) >= 2 THEN 'hi' ELSE 'en' END AS script FROM documents""" % ", ".join(f"'{w}'" for w in T.ROMANISED_HINDI))
def script_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", T.script_language(F.col("text")).alias("script"))


@query(r"""WITH m AS (SELECT conv_id, turn, turn %% 3 = 1 AS pending, turn %% 3 = 2 AS shortlist, regexp_replace(lower(trim(text)), '[!.,? ]+$', '') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN t IN (%s) THEN 'greeting' WHEN pending THEN 'answer' WHEN shortlist AND (regexp_matches(t, '%s') OR regexp_matches(t, '#\s*[0-9]+|\bnumber\s*[0-9]+|\b[0-9]+\b') OR regexp_matches(t, '\b(%s)\b')) THEN 'scheme_lookup' ELSE 'search' END AS intent FROM m""" % (", ".join(f"'{g}'" for g in T.GREETINGS), "|".join(T.LOOKUP_PHRASES), "|".join(T.ORDINALS)))
def message_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _read(spark, sf_dir, "conversations")
    return messages.select("conv_id", "turn", T.message_intent(F.col("text"), None, F.col("turn") % 3 == 1, F.col("turn") % 3 == 2).alias("intent"))


@query(r"""WITH n AS (SELECT p_partkey AS slug, p_name AS name, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '\([^)]*\)', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS norm FROM part),
t AS (SELECT DISTINCT name || ' x' AS target, norm || ' x' AS norm FROM n WHERE slug % 50 = 0), tt AS (SELECT target, list_distinct(string_split(norm, ' ')) AS tt FROM t), r AS (SELECT slug, list_distinct(string_split(norm, ' ')) AS rt FROM n),
s AS (SELECT target, slug, len(list_intersect(tt, rt)) / len(tt) AS overlap, len(list_filter(rt, lambda w: NOT list_contains(tt, w))) AS extra FROM tt, r),
b AS (SELECT target, arg_max(struct_pack(slug := slug, overlap := overlap), struct_pack(a := overlap, b := -extra, c := -slug)) AS x FROM s WHERE overlap >= 0.5 GROUP BY target)
SELECT tt.target, x.slug AS slug, CASE WHEN x IS NULL THEN 'none' ELSE 'fuzzy' END AS match_type, round(x.overlap, 6) AS overlap FROM tt LEFT JOIN b ON tt.target = b.target""")
def fuzzy_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part")
    records = parts.select(F.col("p_partkey").alias("slug"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("name"))
    targets = parts.where("p_partkey % 50 = 0").select(F.concat("p_name", F.lit(" x")).alias("target")).distinct()
    return retrieval.fuzzy_match(targets, records, [], 0.5).withColumn("overlap", F.round("overlap", 6))


_SECTIONS = [("head", "<head>"), ("nav", "<nav>"), ("article", "<article>"), ("footer", "<footer>")]


@query("""WITH a AS (SELECT page_id, html, strpos(html, '<head>') AS h FROM pages), b AS (SELECT *, strpos(substring(html, h + 6), '<nav>') + h + 5 AS n FROM a), c AS (SELECT *, strpos(substring(html, n + 5), '<article>') + n + 4 AS r FROM b), d AS (SELECT *, strpos(substring(html, r + 9), '<footer>') + r + 8 AS f FROM c)
SELECT page_id, length(trim(substring(html, 1, h - 1))) AS intro, length(trim(substring(html, h + 6, n - h - 6))) AS head, length(trim(substring(html, n + 5, r - n - 5))) AS nav, length(trim(substring(html, r + 9, f - r - 9))) AS article, length(trim(substring(html, f + 8))) AS footer FROM d""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    parts = retrieval.anchor_sections(F.col("html"), _SECTIONS)
    return pages.select("page_id", *[F.length(c).cast("long").alias(n) for n, c in parts.items()])


@query()
def mojibake_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages texts of all languages as Windows-1252 readers do, but for every fourth, and repairs what is flagged.

    SQL has no such codec; a test holds the repair against Python's.
    """
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    broken = F.replace(F.replace("text", F.lit("é"), F.lit("Ã©")), F.lit(" la "), F.lit(" â€œlaâ€\u009d "))
    damaged = docs.withColumn("text", F.when(F.col("doc_id") % 4 != 0, broken).otherwise(F.col("text")))
    return fix_mojibake(damaged, "text").select("doc_id", F.sha2("text", 256).alias("sha256"))


def _search(spark: SparkSession, sf_dir: str, asked: str) -> tuple[DataFrame, DataFrame]:
    """The vectors, and as queries those that a condition picks."""
    vectors = _read(spark, sf_dir, "embeddings")
    return vectors, vectors.where(asked).select(F.col("vec_id").alias("query_id"), "embedding")


_DOT = "round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


@query(f"SELECT e.vec_id, {_DOT} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.top_k(*_search(spark, sf_dir, "vec_id = 0"), 10)
    return found.select("vec_id", F.round("score", 6).alias("score"))


_ALL = f"""SELECT q.vec_id AS query_id, e.vec_id, e.label = 3 AS v, {_DOT} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id)::INT AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0"""


@query(f"SELECT query_id, vec_id, score, rank FROM ({_ALL}) WHERE rank <= 10")
def cosine_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cosine_topk for every vector whose id is divisible by 100."""
    found = retrieval.top_k(*_search(spark, sf_dir, "vec_id % 100 = 0"), 10)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH s AS (SELECT e.vec_id, e.label = 3 AS v, {_DOT} AS score, row_number() OVER (ORDER BY list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rn FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
w AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY rn) AS n FROM s WHERE rn <= 200), k AS (SELECT least(2, count(*) FILTER (WHERE v)) AS kept FROM w)
SELECT vec_id, score, row_number() OVER (ORDER BY rn)::INT AS rank FROM w, k WHERE CASE WHEN v THEN n <= 2 ELSE n <= 8 - kept END""")
def tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.tiered_search(*_search(spark, sf_dir, "vec_id = 0"), 8, F.col("label") == 3)
    return found.select("vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH s AS ({_ALL}), w AS (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY rank) AS n FROM s WHERE rank <= 200), k AS (SELECT query_id, least(2, count(*) FILTER (WHERE v)) AS kept FROM w GROUP BY 1)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY w.rank)::INT AS rank FROM w JOIN k USING (query_id) WHERE CASE WHEN v THEN n <= 2 ELSE n <= 8 - kept END""")
def tiered_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tiered_search for every vector whose id is divisible by 100."""
    found = retrieval.tiered_search(*_search(spark, sf_dir, "vec_id % 100 = 0"), 8, F.col("label") == 3)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("""WITH k AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS d FROM events), c AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS middle FROM events), f AS (SELECT k.* FROM k, c WHERE d IS NULL OR d <= middle),
m AS (SELECT user_id, max(d) AS last FROM f GROUP BY user_id) SELECT f.user_id, event_id FROM f JOIN m ON f.user_id = m.user_id WHERE d IS NULL OR d = last""")
def asof_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dated versions of their users, as of the middle of the period; every tenth is undated."""
    events = _read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    versions = events.withColumn("effective_date", F.when(F.col("event_id") % 10 != 0, F.col("ts")))
    return retrieval.latest_version(versions, "user_id", F.lit(lo + (hi - lo) / 2)).select("user_id", "event_id")


@query("SELECT user_id, event_type AS field, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY ALL")
def answer_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").withColumnRenamed("event_type", "field")
    return ledger.fold_answers(events, ["user_id"], "field", "value", "ts", "event_id").select("user_id", "field", "value")


@query("SELECT ts::DATE AS date, event_type, count(*) AS calls, round(sum(value), 4) AS tokens FROM events GROUP BY ALL")
def ledger_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = ledger.usage_by_day(_read(spark, sf_dir, "events"), "ts", "value", ["event_type"])
    return days.select("date", "event_type", "calls", F.round("tokens", 4).alias("tokens"))


@query("""WITH m AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1)::INT AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, event_type AS cause, min(event_id) AS start, count(*) AS n FROM i GROUP BY user_id, g, event_type""")
def retry_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events of one type for each user."""
    events = _read(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("cause"), F.col("value").cast("string").alias("setting"))
    return ledger.merge_runs(events, ["user_id"], "event_id", "cause", "setting").select("user_id", "cause", "start", "n")


@query(f"""WITH {_COUNTS}, a AS (SELECT v.scheme_id, v.verdict AS e, CASE WHEN v.profile_id % 3 = 0 THEN 'eligible' WHEN v.profile_id % 3 = 1 THEN 'ineligible' ELSE 'undetermined_missing_facts' END AS b FROM verdicts v WHERE scheme_id = 'H1'),
r AS (SELECT scheme_id, CASE WHEN b = e THEN 'agree' WHEN b = 'eligible' AND e = 'ineligible' THEN 'false_positive_vs_ineligible' WHEN b = 'eligible' AND e = 'undetermined_missing_facts' THEN 'false_positive_vs_undetermined' WHEN b = 'ineligible' AND e = 'eligible' THEN 'false_negative' WHEN b = 'undetermined_missing_facts' THEN 'over_cautious' ELSE 'other' END AS r FROM a)
SELECT scheme_id, count(*) AS n, avg((r = 'agree')::INT) AS agreement, avg((r LIKE 'false_positive%')::INT) AS harmful_positive, count(*) FILTER (WHERE r = 'agree') AS agree, count(*) FILTER (WHERE r = 'false_positive_vs_ineligible') AS false_positive_vs_ineligible, count(*) FILTER (WHERE r = 'false_positive_vs_undetermined') AS false_positive_vs_undetermined,
count(*) FILTER (WHERE r = 'false_negative') AS false_negative, count(*) FILTER (WHERE r = 'over_cautious') AS over_cautious, count(*) FILTER (WHERE r = 'other') AS other FROM r GROUP BY scheme_id""")
def direct_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = evaluate.evaluate(H.profiles(spark, sf_dir), [H.H1])
    said = F.element_at(F.array(*[F.lit(x) for x in (evaluate.ELIGIBLE, evaluate.INELIGIBLE, evaluate.UNDETERMINED)]), (F.col("profile_id") % 3 + 1).cast("int"))
    return scoring.direct_answer_report(verdicts.select("scheme_id", said.alias("baseline_verdict"), F.col("verdict").alias("evaluator_verdict")))


@query("""WITH p AS (SELECT DISTINCT c_mktsegment AS scheme_id, c_nationkey % 5 AS sample, 'nation' || c_nationkey // 5 AS field FROM customer), t AS (SELECT scheme_id, count(DISTINCT sample) AS samples FROM p GROUP BY 1 HAVING count(DISTINCT sample) >= 2),
a AS (SELECT p.scheme_id, field, count(DISTINCT sample) AS hits FROM p GROUP BY ALL) SELECT a.scheme_id, count(*) AS predicates, avg((hits = samples)::INT) AS unanimous, round(avg(hits / samples), 6) AS mean_agreement FROM a JOIN t ON a.scheme_id = t.scheme_id GROUP BY 1""")
def self_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments as schemes, their nations as predicates of five samples."""
    rows = _read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("scheme_id"), (F.col("c_nationkey") % 5).alias("sample"), F.concat(F.lit("nation"), F.floor(F.col("c_nationkey") / 5).cast("int")).alias("field")).distinct()
    return confidence.sample_agreement(confidence.agreement(rows, ["field"])).withColumn("mean_agreement", F.round("mean_agreement", 6))


from verdictlake import catalog_reports, catalog_rules, catalog_text  # noqa: E402, F401

catalog_reports.register(_COUNTS)
