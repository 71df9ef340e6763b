"""Rows and the intervals that cover them, as an equi-join.

Positions are cut into buckets of equal width; an interval is listed once for each bucket
it touches, a row stands in one, and the join on the bucket leaves the exact bounds to a
filter.  So a row only meets the intervals near it, Spark may hash, sort or split the join
as it likes, and neither side has to be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions of a bucket: intervals of some hundred rows touch a few buckets.
WIDTH = 128


def within(rows: DataFrame, intervals: DataFrame, lo: str = "lo", hi: str = "hi", position: str = "t", width: int = WIDTH) -> DataFrame:
    """rows with the columns of every interval with lo <= position < hi, lo and hi left out.  An empty interval covers nothing."""
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    listed = intervals.filter(F.col(lo) < F.col(hi)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(lo)), bucket(F.col(hi) - 1))))
    met = rows.withColumn("_bucket", bucket(F.col(position))).join(listed, "_bucket")
    return met.filter((F.col(position) >= F.col(lo)) & (F.col(position) < F.col(hi))).drop("_bucket", lo, hi)
