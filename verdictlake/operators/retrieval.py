"""Retrieval: as-of versions, cosine top-k, tiered search, fuzzy names, catalogue browsing, sections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdictlake.functions.text import content_tokens, normalize_name


def filter_as_of(chunks: DataFrame, date: Column | None, column: str = "effective_date") -> DataFrame:
    """Rows without a date, or of that date or before; all rows if there is no date to hold to."""
    return chunks if date is None else chunks.where(F.col(column).isNull() | (F.col(column) <= date))


def latest_version(chunks: DataFrame, key: str, date: Column | None = None, column: str = "effective_date") -> DataFrame:
    """Each key's rows of its latest date up to `date`; undated rows stay, keys without a version yet go.

    The latest date is pre-aggregated and joined, so a key with many rows does not meet in one window.
    """
    known = filter_as_of(chunks, date, column)
    last = known.groupBy(key).agg(F.max(column).alias("_last"))
    return known.join(last, key).where(F.col(column).isNull() | (F.col(column) == F.col("_last"))).drop("_last")


def asof_join(requests: DataFrame, versions: DataFrame, key: str, date: str, effective: str, tie: list[str], days: int = 30) -> DataFrame:
    """requests with `version`, a struct of each one's key's latest version up to the request's own date; null if there is none.

    versions: key, effective date, tie columns (of versions of one date the largest counts) and more. Versions without
    date and requests without date find nothing; null keys do not match; repeated requests stay.

    Dates are dealt into spans of `days`: within a key and span the last version is carried forward to the dates asked
    for, across spans by one row each, so a key with very many dates is many small windows. Each different date of a
    key is asked for once, and comes back to its requests by an equi-join.
    """
    span = F.floor(F.unix_timestamp(F.col("_at").cast("timestamp")) / (86_400 * days)).alias("_span")
    last = versions.where(F.col(key).isNotNull() & F.col(effective).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(effective).alias("_at")).agg(F.max_by(F.struct(*versions.columns), F.struct(*tie)).alias("_v"))
    asked = requests.where(F.col(key).isNotNull() & F.col(date).isNotNull()).select(F.col(key).alias("_key"), F.col(date).cast(versions.schema[effective].dataType).alias("_at")).distinct()
    rows = last.select("_key", "_at", span, "_v", F.lit(0).alias("_asked")).unionByName(asked.select("_key", "_at", span, F.lit(None).alias("_v"), F.lit(1).alias("_asked")))
    before = Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    ends = last.select("_key", "_at", span, "_v").groupBy("_key", "_span").agg(F.max_by("_v", "_at").alias("_end")).unionByName(asked.select("_key", span).distinct().withColumn("_end", F.lit(None)))
    ends = ends.groupBy("_key", "_span").agg(F.first("_end", True).alias("_end")).select("_key", "_span", F.last("_end", True).over(before).alias("_carried"))
    within = F.last("_v", True).over(Window.partitionBy("_key", "_span").orderBy("_at", "_asked"))
    found = rows.withColumn("_found", within).where("_asked = 1").join(ends, ["_key", "_span"]).select("_key", "_at", F.coalesce("_found", "_carried").alias("version"))
    return requests.join(found, (requests[key] == found["_key"]) & (requests[date].cast(versions.schema[effective].dataType) == found["_at"]), "left").drop("_key", "_at")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def top_k(chunks: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 8192, query_block: int = 4096) -> DataFrame:
    """For each row of queries (query_id, vector) its k nearest rows of chunks by inner product of normalised vectors.

    Columns: query_id, the chunks' columns but the vector, score, rank; ties go to the smaller key, null keys last.
    Rows without a vector or with a null or non-finite component are left out; of vectors of different lengths the
    shorter counts as filled up with zeros; repeated rows of queries count once; no queries or no chunks give no rows.
    Blocks of chunks meet blocks of queries, each pair of blocks keeps k rows a query, and these are merged per query.
    """
    rest = [c for c in chunks.columns if c != vector]
    whole = F.col(vector).isNotNull() & F.forall(F.col(vector), lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    asked = queries.where(whole).select("query_id", F.col(vector).cast("array<double>").alias("_v")).distinct().withColumn("_q", F.xxhash64("_v"))
    rows = chunks.where(whole).select(*rest, F.col(vector).cast("array<double>").alias("_v"))
    n, m = -(-rows.count() // block), -(-asked.count() // query_block)
    spread = lambda df, at, size, other, count: df.withColumn(at, F.pmod(F.xxhash64(*df.columns), F.lit(size)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    left = spread(rows, "_b", max(n, 1), "_a", max(m, 1)).groupBy("_b", "_a")
    right = spread(asked, "_a", max(m, 1), "_b", max(n, 1)).groupBy("_b", "_a")
    out = asked.select("query_id", "_q").join(rows.select(*rest), F.lit(False)).withColumn("score", F.lit(0.0)).schema

    def sizes(column: pa.ChunkedArray) -> np.ndarray:
        return pa.compute.list_value_length(column).to_numpy().astype(np.int64)

    def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
        n, out = sizes(column), np.zeros((len(column), width))
        out[np.arange(width) < n[:, None]] = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return out

    def match(x: pa.Table, q: pa.Table) -> pa.Table:
        parts = []
        if len(x) and len(q):
            width = int(max(sizes(x["_v"]).max(), sizes(q["_v"]).max()))
            xs, qs = matrix(x["_v"], width), matrix(q["_v"], width)
            ids = x[key].fill_null(np.iinfo(np.int64).max).to_numpy() if pa.types.is_integer(x[key].type) else np.array(x[key].to_pylist(), dtype=object)
            for i, v in enumerate(qs):
                score = np.einsum("ij,j->i", xs, v)  # not BLAS: equal vectors get equal sums wherever they lie
                near = np.arange(len(xs)) if len(xs) <= k else np.flatnonzero(score >= np.partition(score, len(xs) - k)[len(xs) - k])
                near = near[np.lexsort((ids[near], -score[near]))[:k]]
                part = x.select(rest).take(pa.array(near))
                columns = [pa.repeat(q["query_id"][i], len(near)), pa.repeat(q["_q"][i], len(near)), *part.columns, pa.array(score[near])]
                parts.append(pa.table(columns, names=["query_id", "_q", *rest, "score"]))
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], t) for t in (q["query_id"].type, pa.int64(), *(x[c].type for c in rest), pa.float64())], names=["query_id", "_q", *rest, "score"])

    found = left.cogroup(right).applyInArrow(match, out)
    order = Window.partitionBy("query_id", "_q").orderBy(F.desc("score"), F.asc_nulls_last(key))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tiered_search(chunks: DataFrame, queries: DataFrame, k: int, verified: Column, slots: int = 2, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each query the top k of a wide net of max(20 k, 200) with up to `slots` places kept for verified rows.

    No window here holds more than the net of one query.
    """
    net = top_k(chunks.withColumn("_verified", verified), queries, max(20 * k, 200), key, vector)
    query = ["query_id", "_q"]
    net = net.withColumn("_n", F.row_number().over(Window.partitionBy(*query, "_verified").orderBy("rank")))
    kept = F.least(F.lit(slots), F.count_if("_verified").over(Window.partitionBy(*query)))
    chosen = net.withColumn("_kept", kept).where(F.when(F.col("_verified"), F.col("_n") <= slots).otherwise(F.col("_n") <= k - F.col("_kept")))
    return chosen.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy("rank"))).where(F.col("rank") <= k).drop("_verified", "_n", "_kept")


def fuzzy_match(targets: DataFrame, records: DataFrame, states: list[str], least: float = 0.85) -> DataFrame:
    """targets (target) to records (slug, name, ordinal): exact normalised name, else token overlap of `least` or more.

    Overlap is the share of the target's distinct tokens; ties prefer no state token among the extra ones, then fewer
    extra ones, then the earlier record. A pair shares ceil(least * n) of the target's n tokens, so it shares one of
    the n - ceil(least * n) + 1 rarest: only these are joined on, and common words do not multiply rows. Of records with
    the same tokens only the one that wins such ties is joined, so repeated names do not multiply pairs either.
    Columns: target, slug, match_type (exact, fuzzy, none), overlap.
    """
    t = targets.select("target", F.array_distinct(F.filter(F.split(normalize_name(F.col("target")), " "), lambda w: w != "")).alias("tt"), normalize_name(F.col("target")).alias("norm"))
    r = records.select("slug", "ordinal", F.array_sort(F.array_distinct(F.filter(F.split(normalize_name(F.col("name")), " "), lambda w: w != ""))).alias("rt"), normalize_name(F.col("name")).alias("norm"))
    exact = t.join(r.groupBy("norm").agg(F.min_by("slug", "ordinal").alias("slug")), "norm").select("target", "slug", F.lit("exact").alias("match_type"), F.lit(1.0).alias("overlap"))
    todo = t.join(exact.select("target"), "target", "left_anti").where(F.size("tt") > 0)
    first = r.groupBy("rt").agg(F.min("ordinal").alias("ordinal")).select(F.col("rt").alias("_rt"), F.col("ordinal").alias("_first"))
    alone = r.join(first, (F.col("rt") == F.col("_rt")) & F.col("ordinal").eqNullSafe(F.col("_first"))).groupBy("rt", "ordinal").agg(F.max("slug").alias("slug"))
    words = alone.select("slug", "ordinal", "rt", F.explode("rt").alias("w"))
    frequency = words.groupBy("w").agg(F.count("*").alias("df"))
    ranked = todo.select("target", "tt", F.explode("tt").alias("w")).join(frequency, "w", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("target").orderBy("df", "w"))
    rare = ranked.withColumn("p", place).where(F.col("p") <= F.size("tt") - F.ceil(F.size("tt") * least) + 1)
    pairs = rare.join(words, "w").select("target", "tt", "slug", "ordinal", "rt")  # a pair may come more than once: the best of a target stays the same
    extra = F.array_except("rt", "tt")
    scored = pairs.withColumn("overlap", F.size(F.array_intersect("tt", "rt")) / F.size("tt")).where(F.col("overlap") >= least)
    state = F.arrays_overlap(extra, F.array(*map(F.lit, states)).cast("array<string>"))
    best = scored.groupBy("target").agg(F.max(F.struct("overlap", (~state).alias("plain"), (-F.size(extra)).alias("few"), (-F.col("ordinal")).alias("early"), "slug")).alias("b"))
    fuzzy = best.select("target", "b.slug", F.lit("fuzzy").alias("match_type"), "b.overlap")
    found = exact.unionByName(fuzzy)
    return t.select("target").distinct().join(found, "target", "left").select("target", "slug", F.coalesce("match_type", F.lit("none")).alias("match_type"), "overlap")


def browse(catalogue: DataFrame, query: str | None = None, category: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of named rows that hold the query (any case) and category, with the total before paging."""
    rows = catalogue.where(F.col("name").isNotNull() & (F.col("name") != ""))
    if query:
        rows = rows.where(F.contains(F.lower("name"), F.lit(query.lower())))
    if category:
        rows = rows.where(F.array_contains("categories", category))
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("name", "id").offset(offset).limit(limit).join(F.broadcast(total))


def classify_region(label: Column, regions: list[str]) -> Column:
    return F.when(F.trim(label).isin(*regions), "state_or_ut").when(F.coalesce(label, F.lit("")) != "", "central_or_other").otherwise("unknown")


def content_dedup(files: DataFrame, content: str = "text", path: str = "path") -> DataFrame:
    """One row for each content: the one with the shortest path, then the first of those."""
    rest = [c for c in files.columns]
    best = files.groupBy(F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("sha256")).agg(F.min_by(F.struct(*rest), F.struct(F.length(path).alias("l"), F.col(path).alias("p"))).alias("r"))
    return best.select("sha256", "r.*")


def anchor_sections(text: Column, anchors: list[tuple[str, str]], start: Column | None = None) -> dict[str, Column]:
    """Sections of a text by labels searched in order, each from the end of the one before: {name: Column}, and "intro".

    A label that does not occur has a null section and is skipped.
    """
    cursor = F.lit(1) if start is None else start
    first, places = cursor, []
    for name, label in anchors:
        at = F.call_function("locate", F.lit(label), text, cursor)
        at = F.when(at > 0, at)
        places.append((name, at, at + len(label)))
        cursor = F.coalesce(at + len(label), cursor)
    out = {}
    end = F.length(text) + 1
    for name, at, body in reversed(places):
        out[name] = F.trim(F.substr(text, body, end - body))
        end = F.coalesce(at, end)
    out["intro"] = F.trim(F.substr(text, first, end - first))
    return dict(reversed(out.items()))


def markdown_sections(text: Column) -> Column:
    """array<struct<heading, body>> of a text's second-level sections; a leading comment is dropped."""
    t = F.regexp_replace(text, r"(?s)^\s*<!--.*?-->\s*", "")
    parts = F.slice(F.split(t, r"\n## "), 2, 1 << 30)
    return F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "\n", 1))).alias("heading"), F.regexp_replace(F.regexp_replace(p, r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body")))


def coverage(catalogue: DataFrame, fields: list[str]) -> DataFrame:
    """One row: n and the share of rows where each field is not empty."""
    return catalogue.agg(F.count("*").alias("n"), *[F.avg((F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) != "").cast("int")).alias(f"{f}_filled") for f in fields])


def context_text(packed: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """The chosen chunks of each group as one text, in order."""
    return packed.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n\n").alias("context"))


def with_intervals(versions: DataFrame, key: str, start: str = "valid_from") -> DataFrame:
    """Adds valid_to_derived: the next version's start, null for the last one."""
    return versions.withColumn("valid_to_derived", F.lead(start).over(Window.partitionBy(key).orderBy(start)))


def source_adequacy(docs: DataFrame, by: list[str], text: str, size: str, least: int = 200) -> DataFrame:
    """By group: documents, least, most and median size, and how many have fewer than `least` words."""
    words = F.size(F.split(F.trim(text), r"\s+"))
    return docs.groupBy(*by).agg(F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.percentile(size, 0.5).alias("median"), F.count_if(words < least).alias("thin"))


def shortlist_match(messages: DataFrame, names: DataFrame, share: float = 0.6) -> DataFrame:
    """messages (message_id, text) to the name of their shortlist (message_id, place, name) that they speak of.

    A name counts if the message has at least two of its content words (one, if there is no more) and `share` of them;
    the best share wins, the earlier place on ties. Columns: message_id, place, score.
    """
    tokens = names.withColumn("nt", content_tokens(F.col("name")))
    both = messages.select("message_id", content_tokens(F.col("text")).alias("mt")).join(tokens, "message_id")
    shared = F.size(F.array_intersect("mt", "nt"))
    scored = both.where(F.size("nt") > 0).withColumn("score", shared / F.size("nt")).where((shared >= F.least(F.lit(2), F.size("nt"))) & (F.col("score") >= share))
    best = scored.groupBy("message_id").agg(F.max(F.struct("score", (-F.col("place")).alias("p"))).alias("b"))
    return best.select("message_id", (-F.col("b.p")).alias("place"), "b.score")
