"""Pairs: enumeration within groups, aligned pair panels, whitelists, parameter grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def universe(panel: DataFrame, within_groups: bool = True) -> DataFrame:
    """(y, x, grp): pairs in ticker order (of a column ord, if the panel has one); within groups it is an equi-join on the group."""
    order = F.col("ord" if "ord" in panel.columns else "ticker")
    t = panel.select("ticker", "grp", order.alias("o")).distinct()
    a, b = t.select(F.col("ticker").alias("y"), F.col("grp").alias("ga"), F.col("o").alias("oa")), t.select(F.col("ticker").alias("x"), F.col("grp").alias("gb"), F.col("o").alias("ob"))
    on = (F.col("ga") == F.col("gb")) & (F.col("oa") < F.col("ob")) if within_groups else F.col("oa") < F.col("ob")
    return a.join(b, on).select("y", "x", F.col("ga").alias("grp"))


def pair_panel(panel: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(y, x, grp, t, date, py, px, ly, lx): both legs of each pair by date."""
    pairs = universe(panel) if pairs is None else pairs
    a = panel.select(F.col("ticker").alias("y"), "t", "date", F.col("close").alias("py"))
    b = panel.select(F.col("ticker").alias("x"), "t", F.col("close").alias("px"))
    out = pairs.join(a, "y").join(b, ["x", "t"]).filter("py > 0 AND px > 0")
    return out.select("y", "x", "grp", "t", "date", "py", "px", F.log("py").alias("ly"), F.log("px").alias("lx"))


def whitelist(pairs: DataFrame, allowed: DataFrame) -> DataFrame:
    """Pairs in a list (a, b), in whatever order the list names the two."""
    key = allowed.select(F.least("a", "b").alias("k1"), F.greatest("a", "b").alias("k2")).distinct()
    return pairs.join(key, (F.least("y", "x") == F.col("k1")) & (F.greatest("y", "x") == F.col("k2")), "left_semi")


def members(pairs: DataFrame, tickers: DataFrame) -> DataFrame:
    """Pairs both of whose tickers are in a list."""
    t = tickers.select("ticker").distinct()
    return pairs.join(t.withColumnRenamed("ticker", "y"), "y", "left_semi").join(t.withColumnRenamed("ticker", "x"), "x", "left_semi")


def grid(spark, entries, exits) -> DataFrame:
    """(entry, exit) cells with exit < entry: a fixed small table."""
    return spark.createDataFrame([(float(a), float(b)) for a in entries for b in exits if b < a], "entry double, exit double")
