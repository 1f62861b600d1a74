"""Mixing sources to target weights: pivotal dependent rounding of copy numbers through a reduction tree."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdictlake.llm.common import WORD, global_index, stable

# The sources' weights, in code-point order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A document is taken at most so many times.
MOST_COPIES = 3
#: Rows that a leaf of the tree holds on average, and residuals that meet in a node above.
LEAF, FAN_IN = 2000, 64
#: Documents of more than 1 / LARGE of their source's words are rounded first; there are fewer than LARGE of them.
LARGE = 1000


def _key() -> Column:
    return F.xxhash64("doc_id", "text", "source")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """For each source: n, source_size, idx (place in code-point order, null last), target.

    Targets share the size of all sources by weight; one above `most` times its source's size stops there, and the
    excess is shared again by weight. Each round is one aggregate of a row over the table of sources.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = global_index(sources, [F.col("source").asc_nulls_last()], "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    sources = stable(sources.withColumn("w", weight), "mix-weights")
    rate, full = 0.0, F.col("source_size") * float(most)
    while True:
        stops = F.col("w") * F.lit(rate) > full
        row = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(stops, full)).alias("stopped"), F.sum(F.when(~stops, F.col("w"))).alias("open")).first()
        new = ((row["all"] or 0) - (row["stopped"] or 0.0)) / row["open"] if row["open"] else rate
        if new <= rate * (1 + 1e-15):
            break
        rate = new
    return sources.withColumn("target", F.least(F.col("w") * F.lit(rate), full)).drop("w")


def pivot(sizes: np.ndarray, shares: np.ndarray, rng: np.random.Generator) -> int:
    """Makes all shares but one integral, in place; returns the place of the one that is left, or -1.

    Each step moves words between two documents, so that the words taken, the sum of size times share, stay the
    same, up or down at random so that no share's expectation changes, until a share of the two is 0 or 1.
    """
    held, draws = -1, rng.random(len(sizes))
    for i in range(len(sizes)):
        if shares[i] <= 0.0 or shares[i] >= 1.0 or sizes[i] <= 0:
            continue
        if held < 0:
            held = i
            continue
        a, b, p, q = sizes[held], sizes[i], shares[held], shares[i]
        up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)  # words
        if draws[i] * (up + down) < down:
            p, q, at_p, at_q = p + up / a, q - up / b, (1 - p) * a <= up, q * b <= up
            p, q = (1.0 if at_p else p), (0.0 if at_q else q)
        else:
            p, q, at_p, at_q = p - down / a, q + down / b, p * a <= down, (1 - q) * b <= down
            p, q = (0.0 if at_p else p), (1.0 if at_q else q)
        shares[held], shares[i] = p, q
        open_p, open_q = 0.0 < p < 1.0, 0.0 < q < 1.0
        held = held if open_p else i if open_q else -1
    return held


def pivot_by_size(sizes: np.ndarray, shares: np.ndarray, rng: np.random.Generator) -> None:
    """Makes all shares integral, in place: sizes fall, and each stratum down to half its largest size is closed by a draw.

    The words that a draw is off move evenly onto the shares of the smaller documents, as far as these stay within 0 and 1.
    """
    start, over = 0, 0.0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(-sizes, -sizes[start] / 2)))
        left = pivot(sizes[start:stop], shares[start:stop], rng)
        if left >= 0:
            was = shares[start + left]
            shares[start + left] = float(rng.random() < was)
            over += sizes[start + left] * (shares[start + left] - was)
        words = sizes[stop:].sum()
        if words > 0:
            moved = np.clip(shares[stop:] - over / words, 0.0, 1.0)
            over += float(((moved - shares[stop:]) * sizes[stop:]).sum())
            shares[stop:] = moved
        start = stop


def _rounder(seed: int, level: int, columns: list[str], close: bool):
    """A node of the tree: rounds its rows and leaves one share open, or decides that one too if `close`."""

    def work(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "key", "copy"], ascending=[False, True, True], kind="stable", ignore_index=True)
        rng = np.random.default_rng([seed, level, int(group[0]), int(group[1])])
        shares, done = rows["share"].to_numpy(copy=True), np.ones(len(rows), bool)
        if close:
            pivot_by_size(rows["size"].to_numpy(float), shares, rng)
        elif (left := pivot(rows["size"].to_numpy(float), shares, rng)) >= 0:
            done[left] = False
        rows["share"], rows["done"] = shares, done
        return rows[columns]

    return work


def numbered(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Adds copy, a number from 0 for each of the rows with an equal key, without bringing them together.

    Rows are frozen with the partition they were in; each partition numbers its own from where those before it end, so a
    window holds rows of one partition. Which of equal rows has which number is open, which numbers there are is not.
    """
    rows = stable(rows.withColumn("_part", F.spark_partition_id()), name)
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*key, "_part").agg(F.count("*").alias("_n")).select(*key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*key, "_part").orderBy(*key)) - 1)
    return within.join(starts, [*key, "_part"]).withColumn("copy", F.col("_start") + F.col("_in")).drop("_part", "_in", "_start")


def mix(docs: DataFrame, seed: int = 1, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Returns doc_id, key (a hash of doc_id, text and source), size, source_size, target, copies (long) and taken = size * copies, a row for each document.

    Size is the number of words. A document's expected copies are its source's target over the source's size; the
    whole part is certain and the rest is rounded so that a source's taken words come within a thousandth of its size
    of its target (or one document, where its documents are few). Null text has size 0 and no copies; a null source is a source; repeated rows are documents of
    their own; an empty table gives an empty result. Other columns are not read.
    The draws hang on the seed and the rows alone, so reruns agree whatever the partitions.
    """
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _key().alias("key"))
    sized = stable(numbered(sized, ["key"], "mix-rows"), "mix-sizes")  # key is never null
    sources = stable(targets(sized, weights, most), "mix-targets").withColumn("goal", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    shared = ["doc_id", "key", "copy", "size", "idx", "source_size", "target"]
    joined = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(*shared, "goal", "n")
    large = F.col("size") * LARGE > F.col("source_size")

    # The few large documents of a source first; the words that their rounding is off go onto the others' goals.
    big = _open(joined.where(large), F.col("goal"), most)
    schema = big.select(*shared, "whole", "share", "goal", F.lit(True).alias("done")).schema
    big = stable(big.select(*shared, "whole", "share", "goal", F.lit(0).alias("node")).groupBy("idx", "node").applyInPandas(_rounder(seed, 0, schema.names, close=True), schema), "mix-large")
    off = big.groupBy("idx").agg(F.sum(F.col("size") * (F.col("whole") + F.col("share") - F.col("goal"))).alias("off"), F.sum("size").alias("large"))
    off = stable(sources.join(off, "idx").select("idx", F.when(F.col("source_size") > F.col("large"), F.col("off") / (F.col("source_size") - F.col("large"))).otherwise(0.0).alias("shift")), "mix-shift")
    rest = joined.where(~large).join(off, "idx", "left")
    rest = _open(rest, F.col("goal") - F.coalesce("shift", F.lit(0.0)), most)
    carried = [*shared, "whole", "share"]
    undecided = (F.col("share") > 0) & (F.col("size") > 0)
    level = rest.where(undecided).select(*carried, F.pmod(F.xxhash64("key", "size", "copy"), F.ceil(F.col("n") / LEAF)).alias("node"))
    schema = level.select(*carried, "node", F.lit(True).alias("done")).schema
    deepest = sources.agg(F.max(F.ceil(F.col("n") / LEAF))).first()[0] or 1
    parts = [big.select(*carried), rest.where(~undecided).select(*carried)]
    depths = 1 + max(0, math.ceil(math.log(deepest, FAN_IN) - 1e-9))
    for depth in range(1, depths + 1):
        rounded = stable(level.groupBy("idx", "node").applyInPandas(_rounder(seed, depth, schema.names, close=depth == depths), schema), f"mix-level-{depth}")
        parts.append(rounded.where("done").select(*carried))
        level = rounded.where("NOT done").select(*carried, F.floor(F.col("node") / FAN_IN).alias("node"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("share").cast("long")).otherwise(0).cast("long")
    return out.select("doc_id", "key", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def _open(rows: DataFrame, goal: Column, most: int) -> DataFrame:
    """Adds whole and share: the certain copies and the fraction to round of a goal kept within 0 and most."""
    goal = F.least(F.greatest(goal, F.lit(0.0)), F.lit(float(most)))
    near = F.abs(goal - F.round(goal)) < 1e-9
    whole = F.when(near, F.round(goal)).otherwise(F.floor(goal)).cast("long")
    return rows.withColumn("whole", whole).withColumn("share", F.when(near, 0.0).otherwise(goal - F.col("whole")))


def apply(docs: DataFrame, seed: int = 1) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; columns stay. Equal rows share their copies evenly."""
    taken = stable(mix(docs, seed).groupBy("doc_id", "key").agg(F.sum("copies").alias("_total"), F.count("*").alias("_rows")), "mix-copies")
    keyed = docs.withColumn("_key", _key()).alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("_key") == F.col("t.key"))
    out = keyed.join(taken.where("_rows = 1 AND _total > 0").alias("t"), on).select("d.*", F.col("_total").alias("_copies"))
    if not taken.where("_rows > 1").isEmpty():
        again = keyed.join(taken.where("_rows > 1").alias("t"), on).select("d._key", F.struct("d.*").alias("_doc"), "_total", "_rows")
        again = numbered(again, ["_key"], "mix-equal").withColumn("_copies", F.floor(F.col("_total") / F.col("_rows")) + F.when(F.col("copy") < F.col("_total") % F.col("_rows"), 1).otherwise(0))
        out = out.unionByName(again.select("_doc.*", "_copies"))
    many = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return out.where("_copies > 0").select(*[F.col(c) for c in docs.columns], many.alias("_copy")).drop("_copy")


def op8(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
