"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def frozen(df: DataFrame) -> DataFrame:
    """The rows of df as a checkpoint in spark.checkpoint.dir, computed once; a temporary folder only in local mode where that is unset."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='verdictlake-')}")
    return df.checkpoint()
