"""Secret scans: three base patterns, and an entropy scan over candidate strings, in Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and the least lengths of their kinds.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates of the entropy scan: runs of at least WINDOW characters that a key could be written in.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
SPAN = "STRUCT<s:INT,e:INT,k:STRING,v:STRING>"
#: Least bits a character over some window, for each character class that a candidate can belong to.
ENTROPY_BITS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
#: Strings that look random and are not secret: UUIDs, dates and plain numbers, hyphenated or repeated words, documented sample keys.
ALLOWED = r"(?i)^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9/_=+-]+|[a-z]++(?:[-_/=+][a-z]++)*+[-_/=+]*+|.*example.*|[=_/+-]+)$"


def running(values: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Sums of an array of numbers (or what else `join` makes of them) from the first to each element.

    Every element takes in what stands 1, 2, 4, ... places before it, so n elements need log2(n) passes; a fold that
    appends to an array would copy it at each element.
    """

    def wider(acc: Column, k: Column) -> Column:
        before = lambda i: F.get(acc, i - F.pow(F.lit(2), k).cast("int"))
        return F.transform(acc, lambda x, i: F.coalesce(join(x, before(i)), x))

    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int"))
    return F.when(F.size(values) > 1, F.aggregate(passes, values, wider)).otherwise(values)


def _placed(gaps: Column, hits: Column, kind: str) -> Column:
    """Spans of a pattern's matches, from the texts between them and the matches: they end where so many lengths add up to."""
    sizes = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
    return F.zip_with(running(sizes), hits, lambda end, h: F.struct((end - F.length(h)).alias("s"), end.alias("e"), F.lit(kind).alias("k"), h.alias("v")))


def apart(spans: Column, base: Column, kind: str = SPAN) -> Column:
    """The spans that no base span overlaps, by their ends; they do not overlap each other.

    Starts of base spans and ends of the others are sorted together. A span is apart if no base span that starts before
    its end ends after its start, so the largest end so far decides.
    """
    point = lambda at, late, end, x: F.struct(at.alias("at"), F.lit(late).alias("late"), end.alias("end"), x.alias("x"))
    points = F.array_sort(F.concat(F.transform(base, lambda b: point(b["s"], 1, b["e"], F.lit(None).cast(kind))), F.transform(spans, lambda x: point(x["e"], 0, F.lit(0), x.cast(kind)))))
    seen = F.transform(F.array(points), lambda p: F.zip_with(p, running(F.transform(p, lambda q: q["end"]), F.greatest), lambda q, most: F.struct(q["x"].alias("x"), most.alias("most"))))
    free = F.filter(F.get(seen, F.lit(0)), lambda q: q["x"].isNotNull() & (q["most"] <= q["x"]["s"]))
    return F.when((F.size(spans) > 0) & (F.size(base) > 0), F.transform(free, lambda q: q["x"])).otherwise(F.transform(spans, lambda x: x.cast(kind)))


#: Codes of the characters of candidates, "+" to "z".
FIRST_CODE, CODES = 43, 80


def _moved(counts: Column, out: Column, new: Column) -> Column:
    """counts, one less of the character `out` and one more of another, `new`; the array is copied once."""
    low, high, step = F.least(out, new), F.greatest(out, new), F.when(out < new, 1).otherwise(-1)
    return F.concat(F.slice(counts, F.lit(1), low), F.array(F.get(counts, low) - step), F.slice(counts, low + 2, high - low - 1), F.array(F.get(counts, high) + step), F.slice(counts, high + 2, F.lit(CODES)))


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits a character, over the windows of a string; null if it is shorter than a window.

    Characters are those of CANDIDATE. An array holds the count of each of them and is changed by the one character
    that leaves and the one that enters a window, as is the sum of c * log2(c) over the counts; only the first window
    is counted in full. The string is split once, so time is in proportion to its length.
    """
    terms = F.array(*[F.lit(0.0), *(F.lit(float(c)) * F.log2(F.lit(float(c))) for c in range(1, window + 1))])
    term = lambda c: F.get(terms, c)
    none = F.array_repeat(F.lit(0), CODES)

    def slide(acc: Column, pair: Column) -> Column:
        out, new = pair["out"], pair["new"]
        c_out, c_new = F.get(acc["counts"], out), F.get(acc["counts"], new)
        total = acc["sum"] - term(c_out) + term(c_out - 1) - term(c_new) + term(c_new + 1)
        moved = F.struct(_moved(acc["counts"], out, new).alias("counts"), total.alias("sum"), F.least(acc["low"], total).alias("low"))
        return F.when(out == new, acc).otherwise(moved)

    def low(codes: Column) -> Column:
        rest = F.size(codes) - window
        pairs = F.zip_with(F.slice(codes, F.lit(1), rest), F.slice(codes, F.lit(window + 1), rest), lambda o, n: F.struct(o.alias("out"), n.alias("new")))
        first = F.aggregate(F.slice(codes, 1, window), none, lambda counts, c: F.transform(counts, lambda n, i: n + F.when(i == c, 1).otherwise(0)))
        start = F.transform(F.array(first), lambda counts: F.struct(counts.alias("counts"), F.aggregate(counts, F.lit(0.0), lambda a, c: a + term(c)).alias("sum")))
        start = F.transform(start, lambda x: F.struct(x["counts"].alias("counts"), x["sum"].alias("sum"), x["sum"].alias("low")))
        return F.aggregate(pairs, F.get(start, F.lit(0)), slide, lambda acc: acc["low"])

    # what a lambda reads has to be its argument: an expression from outside would be computed again at every step
    codes = F.transform(F.split(value, "(?<=.)(?=.)"), lambda c: F.ascii(c) - FIRST_CODE)
    lowest = F.get(F.transform(F.array(codes), low), F.lit(0))
    return F.when(F.length(value) >= window, F.log2(F.lit(float(window))) - lowest / window)


def looks_secret(value: Column, bits: dict[str, float] = ENTROPY_BITS, window: int = WINDOW) -> Column:
    """Whether a candidate's entropy reaches the bound of its class: hex, letters with digits, or base64."""
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    least = F.when(value.rlike("^[0-9a-fA-F]+$"), bits["hex"]).when(value.rlike("^[A-Za-z0-9]+$"), bits["alnum"]).otherwise(bits["base64"])
    return mixed & ~value.rlike(ALLOWED) & (window_entropy(value, window) >= least)


def scan(docs: DataFrame, text: str = "text", bits: dict[str, float] = ENTROPY_BITS, window: int = WINDOW) -> DataFrame:
    """Adds base and spans, arrays of struct<s,e,k,v> by start and then kind, to docs.

    Base spans are the three patterns' matches. The entropy scan adds spans of kind "entropy" over the
    candidate strings that no base span overlaps. Null text counts as empty; empty text has no spans;
    rows are kept as they are, repeated ones too; other columns pass through (`base`, `spans` and names
    that start with `_` are overwritten).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_t", t)
    none = F.expr("CAST(array() AS ARRAY<STRUCT<s:INT,e:INT,k:STRING,v:STRING>>)")
    has = lambda p: F.col("_t").rlike(p)
    guard = {"assign": r"[:=]", "access": "AKIA", "hex": r"[0-9a-f]{24}", "entropy": CANDIDATE}
    pattern = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    for k in KINDS:
        df = df.withColumn(f"_h_{k}", F.when(has(guard[k]), F.regexp_extract_all(F.col("_t"), F.lit(pattern[k]), F.lit(0))).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)")))
        df = df.withColumn(f"_{k}", F.when(F.size(f"_h_{k}") > 0, _placed(F.split(F.col("_t"), pattern[k], -1), F.col(f"_h_{k}"), k)).otherwise(none))
    keep = {
        "assign": lambda x: F.length(F.regexp_extract(x["v"], ASSIGN_VALUE, 1)) >= 6,
        "access": lambda x: F.length(x["v"]) >= 20,
        "hex": lambda x: F.length(x["v"]) >= 24,
    }
    rank = lambda x: F.struct(x["s"].alias("s"), F.when(x["k"] == "assign", 0).when(x["k"] == "access", 1).when(x["k"] == "hex", 2).otherwise(3).alias("o"), x["e"].alias("e"), x["k"].alias("k"), x["v"].alias("v"))
    plain = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["v"].alias("v"))
    in_order = lambda a: F.transform(F.array_sort(F.transform(a, rank)), plain)
    df = df.withColumn("base", in_order(F.concat(*[F.filter(F.col(f"_{k}"), keep[k]) for k in KINDS[:3]])))
    df = df.withColumn("_free", apart(F.col("_entropy"), F.col("base")))
    df = df.withColumn("_new", F.filter("_free", lambda x: looks_secret(x["v"], bits, window)))
    df = df.withColumn("spans", F.when(F.size("_new") > 0, in_order(F.concat("base", "_new"))).otherwise(F.col("base")))
    return df.drop("_t", "_new", "_free", *[f"_{k}" for k in KINDS], *[f"_h_{k}" for k in KINDS])


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


#: Code points of a block: pieces of a text are taken out of the blocks that they lie in, as places are counted from its start.
BLOCK = 4096


def redact(docs: DataFrame, mark: str = "<SECRET>", text: str = "text") -> DataFrame:
    """Replaces every found span in the text by a mark, overlapping spans by one; other columns and rows stay, null text stays null."""
    df = scan(docs.withColumn("_row", F.struct(*docs.columns)).select("_row", F.col(text).alias("text")))
    found = F.size("spans") > 0
    df = df.withColumn("_blocks", F.when(found, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    df = df.withColumn("_most", F.when(found, running(F.transform("spans", lambda x: x["e"]), F.greatest)))

    def piece(start: Column, end: Column) -> Column:
        first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        return F.substr(F.array_join(F.slice(F.col("_blocks"), first + 1, last - first + 1), ""), F.pmod(start, F.lit(BLOCK)) + 1, end - start)

    before = F.concat(F.array(F.lit(0)), F.slice("_most", F.lit(1), F.size("_most") - 1))
    parts = F.zip_with("spans", before, lambda x, at: F.when(x["s"] >= at, F.concat(piece(at, x["s"]), F.lit(mark))).otherwise(""))
    clean = F.when(found, F.concat(F.array_join(parts, ""), piece(F.element_at("_most", -1), F.length("text")))).otherwise(F.col("text"))
    return df.select(clean.alias("_clean"), "_row.*").withColumn(text, F.col("_clean")).drop("_clean").select(*docs.columns)


def op4(docs: DataFrame) -> DataFrame:
    df = scan(docs.select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{k}")
    return df.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
