"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdictlake.llm.common import stable

#: Tables, signed axes probed in each table, neighbours returned, and vectors of a bucket that one task compares at once.
TABLES, PROBES, NEAREST, BLOCK = 12, 12, 20, 8192
SEED = 7
ROUNDS = 3  # of sign flips and Hadamard transforms in a pseudo-rotation


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x


def rotated(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """A table's pseudo-rotation: sign flips and Hadamard transforms in turn, padded with zeros to a power of two."""
    d = 1 << max(0, int(x.shape[1] - 1).bit_length())
    signs = np.random.default_rng([seed, table]).choice((-1.0, 1.0), size=(ROUNDS, d))
    out = np.zeros((len(x), d))
    out[:, : x.shape[1]] = x
    for s in signs:
        out = hadamard(out * s) / np.sqrt(d)
    return out


def buckets(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The `probes` nearest signed axes of each row, nearest first: axis a is 2 a for +, 2 a + 1 for -."""
    y = rotated(x, table)
    probes = min(probes, 2 * y.shape[1])
    scores = np.stack((y, -y), axis=2).reshape(len(y), -1)
    order = np.argsort(-scores, axis=1, kind="stable")
    return order[:, :probes]


def usable(vector: Column) -> Column:
    """Neither null nor zero, nor with a component that is null or not finite."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(rows: list, width: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are filled up with zeros."""
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, nearest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's `nearest` largest inner products with rows other than its own id, ties to smaller ids.

    A matrix product finds who can be among them; the score itself is the sum of a row's products, always in the
    same order, so equal vectors have equal scores.
    """
    for lo in range(0, len(queries), 256):
        rough = queries[lo : lo + 256] @ rows.T
        for i, q in enumerate(queries[lo : lo + 256]):
            own = query_ids[lo + i]
            line = np.where(ids == own, -np.inf, rough[i])
            if len(line) > nearest:
                cut = np.partition(line, len(line) - nearest)[len(line) - nearest]
                pick = np.flatnonzero(line >= cut - 1e-9 * (1.0 + abs(cut)))
            else:
                pick = np.arange(len(line))
            pick = pick[ids[pick] != own]
            score = (rows[pick] * q).sum(axis=1)
            order = np.lexsort((ids[pick], -score))[:nearest]
            yield own, ids[pick][order], score[order]


def search(vectors: DataFrame, queries: Column, nearest: int = NEAREST, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """vectors (vec_id, embedding) and a condition that says which of them are queries, to query_id, rank, vec_id, score.

    Every vector lies in one bucket a table, that of its nearest signed axis; a query looks into the buckets of its
    `probes` nearest axes in each. All vectors found are ranked by inner product in double precision, ties to the
    smaller id. A bucket is compared in blocks of BLOCK vectors, so no bucket is too large for a task and none is cut.
    A query that finds fewer than `nearest` looks into all buckets of one table, which is all vectors.
    Vectors that are null, zero, or hold nulls or non-finite numbers take no part, nor do rows with a null id; of rows
    with the same id and vector one takes part. Vectors of different lengths are compared as if the shorter one went on
    with zeros. Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    base = vectors.select("vec_id", F.col("embedding").alias("v"), queries.alias("q")).where(F.col("vec_id").isNotNull()).where(usable(F.col("v"))).dropDuplicates(["vec_id", "v"])
    base = stable(base, "ann-vectors")
    width = base.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    axes = 2 << max(0, (width - 1).bit_length())

    def hashed(probes: int, only: int | None = None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, ids, v = _matrix(batch.column("v").to_pylist(), width), batch.column("vec_id"), batch.column("v")
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else x
                for table in range(tables) if only is None else [only]:
                    found = buckets(x, table, probes) if len(x) else np.empty((0, 1), dtype=np.int64)
                    for p in range(found.shape[1]):
                        yield pa.RecordBatch.from_arrays([ids, v, pa.array(np.full(len(x), table, dtype=np.int32)), pa.array(found[:, p].astype(np.int32))], names=["vec_id", "v", "table", "bucket"])

        return run

    kind = base.schema["v"].dataType.simpleString()  # as given: floats take half the bytes of doubles on their way
    schema = f"vec_id long, v {kind}, table int, bucket int"
    sizes = stable(base.select("vec_id", "v").mapInArrow(hashed(1), schema).groupBy("table", "bucket").agg(F.count("*").alias("n")), "ann-sizes")  # tables * axes rows at most
    sizes = F.broadcast(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"))
    index = base.select("vec_id", "v").mapInArrow(hashed(1), schema).join(sizes, ["table", "bucket"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")

    def compared(asked: DataFrame) -> DataFrame:
        """Each asked query's nearest in each bucket block that it looks into."""
        spread = asked.join(sizes, ["table", "bucket"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

        def match(_: tuple, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(x):
                return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
            found = list(best(_matrix(q["v"].tolist(), width), q["vec_id"].to_numpy(), _matrix(x["v"].tolist(), width), x["vec_id"].to_numpy(), nearest))
            return pd.DataFrame({"query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

        keys = ["table", "bucket", "block"]
        return spread.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(match, "query_id long, vec_id long, score double")

    asked = base.where("q").select("vec_id", "v")
    found = stable(_ranked(compared(asked.mapInArrow(hashed(probes), schema)), nearest), "ann-found")
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= nearest)
    short = stable(asked.join(enough, asked["vec_id"] == enough["query_id"], "left_anti"), "ann-short")
    if short.isEmpty():
        return found
    whole = _ranked(compared(short.mapInArrow(hashed(axes, 0), schema)), nearest)
    return found.join(enough, "query_id", "left_semi").unionByName(whole)


def _ranked(found: DataFrame, nearest: int) -> DataFrame:
    """The nearest of each query among what its buckets gave: at most tables * probes * blocks lists of `nearest`."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op6(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.col("vec_id") % 20 == 0)
