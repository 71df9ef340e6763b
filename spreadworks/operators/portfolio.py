"""Portfolios of pairs: daily sums over a calendar, weights, pools and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_total(pnl: DataFrame, dates: DataFrame, capital: float, net: str = "net", held: str = "executed") -> DataFrame:
    """(date, net, n_active, equity) for every date of the calendar; days without rows earn 0.  Pairs are summed before the running sum, whose one window holds a row per date."""
    sums = pnl.groupBy("date").agg(F.sum(net).alias("net"), F.count_if(F.col(held) != 0).alias("n_active"))
    filled = dates.select("date").distinct().join(sums, "date", "left").na.fill(0, ["net", "n_active"])
    return filled.withColumn("equity", F.lit(capital) + F.sum("net").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def inverse_vol_weights(rows: DataFrame, by: list[str], vol: str = "vol") -> DataFrame:
    """Adds weight: the share of 1 / vol in its portfolio (flat members 0; all flat: equal)."""
    w = Window.partitionBy(*by)
    inverse = F.when(F.col(vol) > 1e-12, 1 / F.col(vol)).otherwise(0.0)
    total = F.sum(inverse).over(w)
    return rows.withColumn("weight", F.when(total > 0, inverse / total).otherwise(1.0 / F.count(F.lit(1)).over(w)))


def active_weights(rows: DataFrame, by: list[str], held: str = "executed", cap: float = 0.25, total: float = 1.0) -> DataFrame:
    """Adds weight: equal shares of total among the members with a position that day, none above cap; a rest stays cash."""
    active = F.when(F.col(held) != 0, 1).otherwise(0)
    share = F.lit(total) / F.sum(active).over(Window.partitionBy(*by))
    return rows.withColumn("weight", F.when(active == 1, F.least(share, F.lit(cap))).otherwise(0.0))


def overlap(pool: DataFrame, period: str, key: list[str]) -> DataFrame:
    """(period, n, n_kept): members of each period's pool, and how many of them the previous pool had."""
    before = pool.select((F.col(period) + 1).alias(period), *key, F.lit(1).alias("kept")).distinct()
    return pool.join(before, [period, *key], "left").groupBy(period).agg(F.count(F.lit(1)).alias("n"), F.count("kept").alias("n_kept"))


def before_unseen(history: DataFrame, unseen: DataFrame) -> DataFrame:
    """History without anything on or after the first unseen date (one row, broadcast), so that a test period stays unseen."""
    first = unseen.agg(F.min("date").alias("first_unseen"))
    return history.join(F.broadcast(first), F.col("date") < F.col("first_unseen")).drop("first_unseen")


def split_at(rows: DataFrame, by: list[str], order: str, cut, value: str) -> DataFrame:
    """Sum, mean and count of value before the cut and from it on, in one pass."""
    late = F.col(order) >= F.lit(cut)
    return rows.groupBy(*by).agg(
        F.count_if(~late).alias("n_in"), F.count_if(late).alias("n_out"), F.sum(F.when(~late, F.col(value))).alias("in_sum"), F.sum(F.when(late, F.col(value))).alias("out_sum"),
        F.avg(F.when(~late, F.col(value))).alias("in_mean"), F.avg(F.when(late, F.col(value))).alias("out_mean"),
    )
