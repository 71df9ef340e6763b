"""How work is dealt out to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with those of a key together, dealt over as many tasks as a shuffle has.

    Adaptive execution joins partitions by their bytes.  A unit-root test or a machine takes seconds over a few bytes, and would run
    in one task however many cores there are; partitions that are asked for by number stay.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
