"""Cutting lineage where several branches of a study read one costly table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder (spark.checkpoint.dir).

    Where none is set, one machine alone goes on without (results are the same), and a cluster is refused.
    """
    context = df.sparkSession.sparkContext
    if context.getConf().get("spark.checkpoint.dir"):
        return df.checkpoint()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return df
