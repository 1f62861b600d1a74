"""Personal data: base patterns, and identifiers that contexts learned from them point at, in Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.common import hot_keys, join_split, stable
from verdictlake.llm.secret_scan import _placed, apart, written

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive repeats and the looks behind keep long runs linear; matches stay the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Ways to write the signs of an address in words or brackets.
AT_MARK, AT_WORD = r"\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?", r"\x20(?:at|AT)\x20"
DOT_MARK, DOT_WORD = r"\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?", r"\x20(?:dot|DOT)\x20"
_DOT, _LABEL = rf"(?:\.|{DOT_MARK}|{DOT_WORD})", "[A-Za-z0-9-]++"
#: Strings in identifier form that no base pattern need match: long numbers with separators, mail addresses written out
#: in full or in part, and addresses whose dots are set in brackets.
NUMBER = r"(?<![A-Za-z0-9+])[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![A-Za-z0-9])"
MAIL = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:{AT_MARK}{_LABEL}(?:{_DOT}{_LABEL})*+|(?:@|{AT_WORD}){_LABEL}(?:{_DOT}{_LABEL})++)"
ADDRESS = rf"(?<![0-9])[0-9]{{1,3}}(?:{DOT_MARK}[0-9]{{1,3}}){{3}}(?![0-9])"
CANDIDATE = f"{ADDRESS}|{NUMBER}|{MAIL}"
CANDIDATE_GUARD = rf"[0-9](?:[\x20().-]{{0,2}}[0-9]){{6}}|{AT_MARK}|{DOT_MARK}|(?:@|{AT_WORD}){_LABEL}{_DOT}"


def luhn(value: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str) -> Callable[[Column], Column]:
    """What a match of a kind's pattern has to satisfy."""

    def small(part: Column) -> Column:
        digits = F.ltrim(part, F.lit("0"))
        return (F.length(digits) <= 3) & (F.concat(F.lit("0"), F.left(digits, F.lit(3))).cast("int") <= 255)

    def check(x: Column) -> Column:
        digits = F.length(F.regexp_replace(x["v"], "[^0-9]", ""))
        if kind == "email":
            return F.lit(True)
        if kind == "ip":
            return F.forall(F.split(x["v"], r"\."), small)
        if kind == "card":
            return F.when(digits.between(16, 19), luhn(x["v"])).otherwise(False)
        return digits.between(8, 15)

    return check


SPAN = "STRUCT<s:INT,e:INT,k:STRING,v:STRING,p:ARRAY<STRING>>"


def _with_context(gaps: Column, hits: Column, kind: str) -> Column:
    """Like _placed, each span with the patterns of the texts on its left and right, up to the next match of its own pattern."""
    spans = F.zip_with(_placed(gaps, hits, kind), F.slice(gaps, 1, F.size(hits)), lambda x, left: F.struct(x.alias("x"), left.alias("left")))
    return F.zip_with(spans, F.slice(gaps, 2, F.size(hits)), lambda a, right: F.struct(a["x"]["s"].alias("s"), a["x"]["e"].alias("e"), a["x"]["k"].alias("k"), a["x"]["v"].alias("v"), patterns_of(a["left"], right).alias("p")))


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds base (spans of the four kinds, by kind and start) and cand (spans in identifier form apart from those) to docs."""
    none = F.expr(f"CAST(array() AS ARRAY<{SPAN}>)")
    df = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    for k, p, g in [*((k, PATTERN[k], GUARD[k]) for k in KINDS), ("cand", CANDIDATE, CANDIDATE_GUARD)]:
        df = df.withColumn(f"_h_{k}", F.when(F.col("_t").rlike(g), F.regexp_extract_all(F.col("_t"), F.lit(p), F.lit(0))).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)")))
        df = df.withColumn(f"_g_{k}", F.when(F.size(f"_h_{k}") > 0, F.split(F.col("_t"), p, -1)))
        df = df.withColumn(f"_{k}", F.when(F.size(f"_h_{k}") > 0, _with_context(F.col(f"_g_{k}"), F.col(f"_h_{k}"), k)).otherwise(none))
    df = df.withColumn("base", F.concat(*[F.filter(F.col(f"_{k}"), _holds(k)) for k in KINDS]))
    df = df.withColumn("cand", apart(F.col("_cand"), F.col("base"), SPAN))
    return df.drop("_t", *[f"_{a}{k}" for a in ("", "h_", "g_") for k in (*KINDS, "cand")])


def patterns_of(left: Column, right: Column) -> Column:
    """The lexical patterns of a context: the two words before, and the words on both sides."""
    last = F.lower(F.regexp_extract(left, r"(?<!\p{L})(\p{L}{2,}+)[^\p{L}]{0,6}+$", 1))
    pair = F.lower(F.regexp_extract(left, r"(?<!\p{L})(\p{L}++[^\p{L}]{1,3}+\p{L}{2,}+)[^\p{L}]{0,6}+$", 1))
    after = F.lower(F.regexp_extract(right, r"^[^\p{L}]{0,6}+(\p{L}{2,}+)", 1))
    both = F.when((last != "") & (after != ""), F.concat(F.lit("b:"), last, F.lit("|"), after))
    return F.array_compact(F.array(F.when(pair != "", F.concat(F.lit("l:"), pair)), both))


def _forms(inst: Column) -> Column:
    """The kinds that a candidate's form allows, as a bit for each place in KINDS; inst is as plain() gives it."""
    n = F.length(inst)
    card = F.when(n.between(12, 19), luhn(inst)).otherwise(False)
    bits = {"ip": n <= 12, "card": card, "phone": n.between(7, 15)}
    number = sum((F.when(x, 1 << KINDS.index(k)).otherwise(0) for k, x in bits.items()), F.lit(0))
    return F.when(inst.startswith("ip "), 1 << KINDS.index("ip")).when(inst.rlike("^[0-9]+$"), number).otherwise(1 << KINDS.index("email"))


def plain(kind: Column, value: Column) -> Column:
    """One text for all ways to write an identifier: lower case, signs for words, no separators.

    An IP address keeps its dots, which a number with the same digits has not.
    """
    v = F.regexp_replace(F.lower(value), f"{AT_MARK}|{AT_WORD}", "@")
    v = F.regexp_replace(v, f"{DOT_MARK}|{DOT_WORD}", ".")
    address = (kind == "ip") | ((kind == "cand") & v.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") & value.rlike(f"^{ADDRESS}$"))
    return F.when(address, F.concat(F.lit("ip "), v)).otherwise(F.regexp_replace(v, r"[\x20().-]", ""))


def bootstrap(found: DataFrame, min_seeds: int = 3, confident: float = 0.8) -> DataFrame:
    """Scores the graph of patterns and instances; returns the candidates' rows (key, s, e, v) with kind and confidence.

    found: key columns with base and cand as mentions() gives them. Seeds are known in their kind with confidence 1.
    A pattern's confidence in a kind is the sum w of its known instances' confidences in it over w, plus those known
    in other kinds, plus the number of instances whose form rules the kind out, plus one; other candidates are unknown
    and count neither way. Patterns under `confident`, or with fewer than `min_seeds` known instances of the kind, say
    nothing. A candidate takes the best of its patterns' confidences times the share that is confident in the kind of
    those of its patterns that have `min_seeds` known instances at all; from `confident` on it is known and supports
    patterns of its own in the next round. What is known stays known, so rounds end when one adds nothing.
    Candidates stay, in every place, where a pattern of theirs is confident or their instance is known: an identifier
    found in one document is marked in all. Instances and patterns with many rows are joined apart from the others.
    """
    keys = [c for c in found.columns if c not in ("base", "cand")]
    rows = found.where((F.size("base") > 0) | (F.size("cand") > 0)).select(*keys, F.explode(F.concat("base", "cand")).alias("x"))
    rows = rows.select(*keys, "x.s", "x.e", "x.k", "x.v", plain(F.col("x.k"), F.col("x.v")).alias("plain"), F.col("x.p").alias("pats"))
    inst = F.sha2("plain", 256)
    edges = rows.select(*keys, "s", "e", "k", "v", inst.alias("inst"), F.when(F.col("k") == "cand", _forms(F.col("plain"))).alias("forms"), F.explode_outer("pats").alias("pat"))
    edges = stable(edges, "pii-edges")
    graph = stable(edges.where("pat IS NOT NULL").groupBy("pat", "inst").agg(F.max(F.when(F.col("k") != "cand", F.col("k"))).alias("seed"), F.max("forms").alias("forms")), "pii-graph")
    much, hot = {c: hot_keys(graph, c) for c in ("inst", "pat")}, {c: hot_keys(edges.where("k = 'cand'"), c) for c in ("inst", "pat")}
    known = stable(edges.where("k <> 'cand'").groupBy("inst").agg(F.max("k").alias("kind")).withColumn("conf", F.lit(1.0)), "pii-instances")
    while True:
        of = lambda k: F.col("kind") == k
        against = lambda k: F.col("kind").isNull() & (F.col("forms").bitwiseAND(1 << KINDS.index(k)) == 0)
        counts = [c for k in KINDS for c in (F.sum(F.when(of(k), F.col("conf")).otherwise(0.0)).alias(f"w_{k}"), F.count_if(of(k)).alias(f"n_{k}"), F.count_if(against(k)).alias(f"no_{k}"))]
        score = join_split(graph, known, "inst", much["inst"], "left").groupBy("pat").agg(*counts).where(sum((F.col(f"n_{k}") for k in KINDS), F.lit(0)) >= min_seeds)
        whole = sum((F.col(f"w_{k}") for k in KINDS), F.lit(0.0))
        kinds = F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(f"w_{k}") / (whole + F.col(f"no_{k}") + 1)).alias("pc"), F.col(f"n_{k}").alias("n")) for k in KINDS])
        judged = stable(score.select("pat", F.filter(kinds, lambda x: (x["n"] >= min_seeds) & (x["pc"] >= confident)).alias("good")), "pii-patterns")
        free = join_split(join_split(graph.where("seed IS NULL"), known.select("inst"), "inst", much["inst"], "left_anti"), judged, "pat", much["pat"])
        degree = free.groupBy("inst").agg(F.count("*").alias("d"))
        votes = free.select("inst", "forms", F.explode("good").alias("g")).where(F.col("forms").bitwiseAND(F.element_at(F.create_map(*[F.lit(x) for k in KINDS for x in (k, 1 << KINDS.index(k))]), F.col("g.kind"))) != 0)
        votes = votes.groupBy("inst", F.col("g.kind").alias("kind")).agg(F.max("g.pc").alias("m"), F.count("*").alias("c")).join(degree, "inst")
        new = votes.select("inst", "kind", (F.col("m") * F.col("c") / F.col("d")).alias("conf")).where(F.col("conf") >= confident)
        new = stable(new.groupBy("inst").agg(F.max(F.struct("conf", "kind")).alias("b")).select("inst", "b.kind", "b.conf"), "pii-new")
        if new.isEmpty():
            break
        known = stable(known.unionByName(new), "pii-instances")
    marked = edges.where(F.col("k") == "cand")
    by_instance = join_split(marked, known, "inst", hot["inst"]).select(*keys, "s", "e", "v", F.col("conf").alias("pc"), "kind")
    by_pattern = join_split(marked.where("pat IS NOT NULL"), judged, "pat", hot["pat"]).select(*keys, "s", "e", "v", F.explode("good").alias("g")).select(*keys, "s", "e", "v", "g.pc", "g.kind")
    best = by_pattern.unionByName(by_instance).groupBy(*keys, "s", "e", "v").agg(F.max(F.struct("pc", "kind")).alias("b"))
    return best.select(*keys, "s", "e", "v", F.col("b.kind").alias("kind"), F.col("b.pc").alias("conf"))


def extract(docs: DataFrame, key: list[str], text: str = "text", **options) -> DataFrame:
    """Returns key columns, base and spans: arrays of struct<s,e,k,v> by kind and start; spans adds what contexts found.

    One row for each row of docs. Null text counts as empty; empty text has no spans; repeated rows give repeated
    results; null keys are kept. Columns besides key and text are not read.
    """
    slim = docs.select(*[F.col(c) for c in key], F.col(text).alias("_text"))
    found = mentions(slim.withColumn("_row", F.xxhash64("_text")), "_text").drop("_text")
    found = stable(found, "pii-mentions")
    more = bootstrap(found, **options).groupBy(*key, "_row").agg(F.collect_set(F.struct("s", "e", F.col("kind").alias("k"), "v")).alias("_new"))
    on = [found[c].eqNullSafe(more[c]) for c in (*key, "_row")]
    plain = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["v"].alias("v")))
    rank = lambda x: F.struct(F.array_position(F.lit(list(KINDS)), x["k"]).alias("o"), x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["v"].alias("v"))
    back = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["v"].alias("v"))
    out = found.join(more, on, "left").select(*[found[c] for c in key], plain.alias("base"), F.col("_new"))
    joined = F.transform(F.array_sort(F.transform(F.concat("base", "_new"), rank)), back)
    return out.select(*key, "base", F.when(F.size("_new") > 0, joined).otherwise(F.col("base")).alias("spans"))


def op1(docs: DataFrame) -> DataFrame:
    df = extract(docs, ["doc_id"])
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{k}")
    return df.select("doc_id", *[n(k) for k in KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
