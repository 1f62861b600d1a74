"""Queries over texts: languages, answers, plausibility, estimates, sections and contexts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.catalog_base import query, read
from verdictlake.functions import text as T
from verdictlake.operators import ledger, retrieval


def _words(number: str, *values: str) -> str:
    """SQL for one of several strings by a number's remainder, for Spark and DuckDB."""
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


@query("SELECT doc_id, contains(CASE WHEN doc_id % 3 = 0 THEN text || 'â€' ELSE text END, 'â') AS damaged FROM documents")
def mojibake_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("â€"))).otherwise(F.col("text")).alias("text"))
    return docs.select("doc_id", T.has_mojibake(F.col("text")).alias("damaged"))


_DEVANAGARI = _words("doc_id", "मी शेतकरी ", "मैं किसान हूँ ", "तुम्ही कोण ", "यह आहे", "करा")


@query(f"WITH t AS (SELECT doc_id, {_DEVANAGARI} || text AS t FROM documents) SELECT doc_id, CASE WHEN list_has_any(regexp_extract_all(t, '[\\x{{0900}}-\\x{{097F}}]+'), [{', '.join(map(repr, T.MARATHI_MARKERS))}]) THEN 'mr' ELSE 'hi' END AS language FROM t")
def devanagari_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", T.devanagari_guess(F.concat(F.expr(_DEVANAGARI), "text")).alias("language"))


@query("SELECT doc_id, n_chars::VARCHAR || '/' || n_chars::VARCHAR || '.' || doc_id::VARCHAR AS digits FROM documents")
def native_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    n = F.col("n_chars").cast("string")
    scripts = [T.NATIVE_DIGITS[i : i + 10] for i in (0, 10, 30)]
    written = F.concat(F.translate(n, "0123456789", scripts[0]), F.lit("/"), F.translate(n, "0123456789", scripts[1]), F.lit("."), F.translate(F.col("doc_id").cast("string"), "0123456789", scripts[2]))
    return docs.select("doc_id", T.ascii_digits(written).alias("digits"))


#: What people answer, and what each answer means: yes or no, a number, a refusal. Others are none of these.
_SAID = [("Yes", True, None, False), (" no ", False, None, False), ("हाँ।", True, None, False), ("nahi", False, None, False), ("maybe", None, None, False), ("12", None, 12.0, False), ("१२.५", None, 12.5, False), ("-3", None, -3.0, False), ("1e3", None, None, False), ("I'd rather not say.", None, None, True), ("skip", None, None, True), ("skipping stones", None, None, False), ("1", True, 1.0, False), ("ஆம்", True, None, False), ("Prefer   not to answer!", None, None, True)]
_ANSWER = f"CASE (conv_id + turn * 3) % {len(_SAID)} " + " ".join("WHEN %d THEN '%s'" % (i, s.replace("'", "''")) for i, (s, *_) in enumerate(_SAID)) + " END"
_SQL = {True: "TRUE", False: "FALSE", None: "NULL"}


@query("SELECT conv_id, turn, CASE (conv_id + turn * 3) % {0} {1} END AS yes, CASE (conv_id + turn * 3) % {0} {2} END AS number, CASE (conv_id + turn * 3) % {0} {3} END AS declined FROM conversations".format(len(_SAID), " ".join(f"WHEN {i} THEN {_SQL[x[1]]}" for i, x in enumerate(_SAID)), " ".join(f"WHEN {i} THEN {'NULL::DOUBLE' if x[2] is None else f'{x[2]}::DOUBLE'}" for i, x in enumerate(_SAID)), " ".join(f"WHEN {i} THEN {_SQL[x[3]]}" for i, x in enumerate(_SAID))))
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_ANSWER.replace("''", "\\'")).alias("t"))
    return said.select("conv_id", "turn", T.parse_boolean(F.col("t")).alias("yes"), T.parse_number(F.col("t")).alias("number"), T.is_decline(F.col("t")).alias("declined"))


@query("SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN (%s)))), ' ') AS tokens FROM conversations" % ", ".join(f"'{w}'" for w in T.STOPWORDS))
def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(T.content_tokens(F.col("text"))), " ").alias("tokens"))


_QUESTION = _words("doc_id", "Do you own land?", "Own land", "Age?", "Is it over 500?", "Is it over $ 5?", "Are you over 60 years old?")


@query(f"""WITH q AS (SELECT doc_id, {_QUESTION} AS q, CASE WHEN doc_id % 12 < 6 THEN 'over_60' ELSE 'land' END AS name FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN NOT length(q) BETWEEN 8 AND 160 THEN 'length' END, CASE WHEN q NOT LIKE '%?' THEN 'no question mark' END, CASE WHEN contains(q, '$') THEN 'currency or percent' END, CASE WHEN (contains(q, '500') OR contains(q, '5?')) OR (contains(q, '60') AND name = 'land') THEN 'digits' END) AS faults FROM q""")
def question_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read(spark, sf_dir, "documents").select("doc_id", F.expr(_QUESTION).alias("q"), F.when(F.col("doc_id") % 12 < 6, "over_60").otherwise("land").alias("name"))
    return q.select("doc_id", F.array_join(T.fails(F.col("q"), F.col("name")), ",").alias("faults"))


_SOURCE, _TARGET = _words("doc_id", "Hello {name}", "**Bold** {a} {b}", "Plain"), _words("CAST(floor(doc_id / 3) AS INT)", "Hallo {name}", "**Fett** {b} {a}", "Plain", "", "Fett** {a}")
_MARKS = "list_sort(regexp_extract_all({0}, '\\{{[a-z_]*\\}}'))"


@query(f"""WITH p AS (SELECT doc_id, {_SOURCE} AS s, {_TARGET} AS t FROM documents) SELECT doc_id, concat_ws(',', CASE WHEN t = '' THEN 'empty' END, CASE WHEN {_MARKS.format('s')} <> {_MARKS.format('t')} THEN 'placeholders' END,
CASE WHEN len(string_split(s, '**')) <> len(string_split(t, '**')) THEN 'bold marks' END, CASE WHEN s = t THEN 'same as source' END) AS faults FROM p""")
def translation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "documents").select("doc_id", F.expr(_SOURCE).alias("s"), F.expr(_TARGET).alias("t"))
    return p.select("doc_id", F.array_join(T.translation_faults(F.col("s"), F.col("t")), ",").alias("faults"))


@query("""WITH l AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS a FROM documents)
SELECT doc_id, round(n / 3.5, 4) AS estimate, round(a / 3.5 + (n - a) / 1.5 + 1, 4) AS cautious, greatest(500, least(4000, 8000 - 150 - n))::BIGINT AS budget FROM l""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.round(T.token_estimate(t), 4).alias("estimate"), F.round(T.cautious_tokens(t), 4).alias("cautious"), T.completion_budget(F.length(t)).cast("long").alias("budget"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || chr(10) || chr(10) || lang ELSE lang END AS assembled, CASE WHEN doc_id % 3 = 0 THEN 'Own Label' ELSE upper(substring(lang, 1, 1)) || substring(lang, 2) || ' of ' || source END AS label FROM documents""")
def assembled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    field = F.concat("lang", F.lit("_of_"), "source")
    parts = T.source_text(F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.lit("  "), F.col("lang"))
    return docs.select("doc_id", parts.alias("assembled"), T.display_label(F.when(F.col("doc_id") % 3 == 0, "Own Label"), field).alias("label"))


@query("SELECT doc_id, unnest(['first ' || lang, 'second']) AS heading, unnest([source || chr(10) || 'more', lang]) AS body FROM documents")
def markdown_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    page = F.concat(F.lit("<!-- note\n## no heading -->\nintro\n## First "), "lang", F.lit("\n"), "source", F.lit("\nmore\n\n## SECOND\n"), "lang", F.lit("\n"))
    return docs.select("doc_id", F.explode(retrieval.markdown_sections(page)).alias("s")).select("doc_id", "s.heading", "s.body")


@query("SELECT source, string_agg(doc_id::VARCHAR, chr(10) || chr(10) ORDER BY n_chars, doc_id) AS context FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 8000 GROUP BY source")
def context_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that context_pack keeps as one text a source; ids stand for the texts."""
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    packed = ledger.pack_context(docs, ["source"], [F.col("n_chars"), F.col("doc_id")], "n_chars", 8000)
    return retrieval.context_text(packed.withColumn("place", F.struct("n_chars", "doc_id")).withColumn("t", F.col("doc_id").cast("string")), ["source"], "place", "t")


@query("SELECT doc_id, regexp_matches(text, '(?i)\\b(family|families|household|anyone|any one of|any member|members|husband|wife|spouse|children|relatives?)\\b') AS household FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || ' Any Member?' WHEN doc_id % 4 = 1 THEN text || ' wifely' ELSE text END AS text FROM documents)")
def household_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.when(F.col("doc_id") % 4 == 0, " Any Member?").when(F.col("doc_id") % 4 == 1, " wifely").otherwise(""))
    return read(spark, sf_dir, "documents").select("doc_id", T.is_household_phrased(text).alias("household"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM documents), s AS (SELECT doc_id, t, string_split(lower(t), 'the') AS p FROM t),
h AS (SELECT doc_id, t, list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + 3 * (i - 1)) AS pos FROM s),
k AS (SELECT doc_id, t, len(pos) AS hits, coalesce(list_reduce(list_transform(pos, lambda x: [x::BIGINT]), lambda a, x: CASE WHEN x[1] - a[len(a)] < 300 THEN a ELSE list_append(a, x[1]) END), []) AS kept FROM h WHERE len(pos) > 0)
SELECT doc_id, hits::BIGINT AS hits, len(kept)::BIGINT AS shown, list_sum(list_transform(kept, lambda x: length(substring(t, greatest(0, x - 160)::BIGINT + 1, (least(length(t), x + 163) - greatest(0, x - 160))::BIGINT))))::BIGINT AS chars FROM k""")
def term_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "documents").select("doc_id", T.term_search(F.col("text"), "THE").alias("f")).where("f.hits > 0")
    return found.select("doc_id", F.col("f.hits").cast("long").alias("hits"), F.size("f.windows").cast("long").alias("shown"), F.aggregate("f.windows", F.lit(0), lambda a, w: a + F.length(w)).cast("long").alias("chars"))


@query("SELECT l_orderkey AS k, l_linenumber AS m, array_to_string(list_sort(list(DISTINCT 'The applicant:' || chr(10) || '  - returned: ' || CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END || chr(10) || '  - quantity: ' || l_quantity::INT)), '|') AS prompt FROM lineitem GROUP BY ALL")
def profile_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as profiles of one person."""
    value = lambda kind, num: F.struct(F.lit(kind).alias("kind"), num.cast("double").alias("num"), F.lit(None).cast("string").alias("str"), F.lit(None).cast("array<string>").alias("arr"))
    facts = F.create_map(F.lit("returned"), value("bool", (F.col("l_returnflag") == "R").cast("int")), F.lit("quantity"), value("num", F.col("l_quantity").cast("int")))
    one = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.profile_text(F.array(F.struct(F.lit(0).alias("ix"), facts.alias("facts")))).alias("p"))
    return one.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("m")).agg(F.array_join(F.array_sort(F.collect_set("p")), "|").alias("prompt"))


_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN (%s)))" % ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"""WITH p AS (SELECT p_partkey AS k, p_name, {_TOKENS.format('p_name')} AS nt FROM part), m AS (SELECT k AS message_id, list_concat({_TOKENS.format("'tell me about ' || p_name")}, ['blue']) AS mt FROM p WHERE k % 3 <> 0),
n AS (SELECT m.message_id, x.place, q.nt FROM m, (VALUES (1, 7), (2, 0), (3, 3)) x(place, off) JOIN p q ON q.k = m.message_id + x.off),
s AS (SELECT m.message_id, place, len(list_intersect(mt, nt)) AS shared, len(nt) AS size FROM m JOIN n ON m.message_id = n.message_id WHERE len(nt) > 0)
SELECT message_id, arg_max(place, struct_pack(a := shared / size, b := -place))::INT AS place, round(max(shared / size), 6) AS score FROM s WHERE shared >= least(2, size) AND shared / size >= 0.6 GROUP BY message_id""")
def shortlist_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as schemes: who speaks of one has it and two others on the list."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name")
    messages = parts.where("k % 3 <> 0").select(F.col("k").alias("message_id"), F.concat(F.lit("tell me about "), "p_name", F.lit(" blue")).alias("text"))
    asked = messages.select("message_id", F.explode(F.create_map(*[F.lit(x) for pair in ((1, 7), (2, 0), (3, 3)) for x in pair])).alias("place", "off"))
    names = asked.withColumn("k", F.col("message_id") + F.col("off")).join(parts, "k").select("message_id", "place", F.col("p_name").alias("name"))
    return retrieval.shortlist_match(messages, names).withColumn("score", F.round("score", 6))
