"""The numbered operators' queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdictlake.llm import align, ann, html_text, lm, mixing, ngram_join, omh, packing, pii, secret_scan, toxicity, turns, warc
from verdictlake.llm.common import ship_package
from verdictlake.llm.oracles import SQL


def _on(table: str, run: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return run(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    return query


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity.op7(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_bootstrap": _on("documents", pii.op1),
    "op2_ngram_components": _on("documents", ngram_join.op2),
    "op3_warc_normalise": _on("pages", warc.op3),
    "op4_secret_entropy": _on("documents", secret_scan.op4),
    "op5_site_template": _on("pages", lambda pages: html_text.op5(pages).select("page_id", "url", "text", "n_chars")),
    "op6_cross_polytope": _on("embeddings", ann.op6),
    "op7_toxicity_chain": _toxicity,
    "op8_pivotal_mix": _on("documents", mixing.op8),
    "op9_order_minhash": _on("documents", omh.op9),
    "op10_linear_grouping_pack": _on("documents", packing.op10),
    "op11_token_alignment": _on("documents", align.op11),
    "op12_deleted_interpolation": _on("documents", lm.op12),
    "op13_turn_repair": _on("conversations", turns.op13),
}
