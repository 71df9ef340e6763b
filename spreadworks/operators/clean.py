"""Cleaning: dense grid, sparse tickers, limited forward fill, complete dates, causal volatility and volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(panel: DataFrame) -> DataFrame:
    """(date, t): positions of the distinct dates.  As small as the number of dates."""
    return panel.select("date").distinct().withColumn("t", F.row_number().over(Window.orderBy("date")) - 1)


def dense(panel: DataFrame) -> DataFrame:
    """A row for every ticker and date."""
    tickers = panel.select("ticker", "grp").distinct()
    grid = tickers.crossJoin(F.broadcast(panel.select("date").distinct()))  # bounded by the calendar: a century of days has 36,525 rows
    return grid.join(panel.drop("grp"), ["ticker", "date"], "left")


def drop_sparse(grid: DataFrame, most_missing: float = 0.05) -> DataFrame:
    """Tickers present on enough dates: a count over the ticker's rows, no second pass over the grid."""
    w = Window.partitionBy("ticker")
    enough = F.count("close").over(w) >= (1 - most_missing) * F.count(F.lit(1)).over(w)
    return grid.withColumn("_keep", enough).filter("_keep").drop("_keep")


def drop_nonpositive(grid: DataFrame) -> DataFrame:
    """Tickers with a price that is not positive go as a whole."""
    return grid.withColumn("_low", F.min("close").over(Window.partitionBy("ticker"))).filter("_low > 0").drop("_low")


def forward_fill(grid: DataFrame, column: str = "close", limit: int | None = 3) -> DataFrame:
    by = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return grid.withColumn(column, F.last(column, ignorenulls=True).over(by))


def complete_dates(grid: DataFrame) -> DataFrame:
    w = Window.partitionBy("date")
    return grid.withColumn("_full", F.count("close").over(w) == F.count(F.lit(1)).over(w)).filter("_full").drop("_full")


def repair_open(rows: DataFrame) -> DataFrame:
    """Opens that are missing or not positive become the close; missing volume becomes 0."""
    return rows.withColumn("open", F.when(F.col("open") > 0, F.col("open")).otherwise(F.col("close"))).withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def clean(panel: DataFrame, most_missing: float = 0.05, limit: int = 3) -> DataFrame:
    """(ticker, grp, date, t, close, volume): sparse tickers out, gaps filled up to limit, dates with a gap out."""
    filled = drop_nonpositive(forward_fill(drop_sparse(dense(panel), most_missing), "close", limit))
    # a row per date, grouped before any shuffle; its join with the rows is broadcast if it turns out small
    full = filled.groupBy("date").agg((F.count("close") == F.count(F.lit(1))).alias("full")).filter("full")
    out = filled.join(full.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("t")), "date")
    return out.select("ticker", "grp", "date", "t", "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))


def keep_one(rows: DataFrame, by: list[str], order: str, last: bool = True) -> DataFrame:
    """One row per key: the last (or first) by order; never an arbitrary one."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc() if last else F.col(order)))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def start_position(dates: DataFrame, day: str) -> DataFrame:
    """(start, before): the position of the first date not before day, and how many dates are not after it."""
    d = F.lit(day).cast("date")
    return dates.agg(F.min(F.when(F.col("date") >= d, F.col("t"))).alias("start"), F.count_if(F.col("date") <= d).alias("before"))


def sig_adv(panel: DataFrame, window: int = 20) -> DataFrame:
    """Yesterday's rolling volatility of log returns (gaps: the ticker's median) and average volume."""
    by = Window.partitionBy("ticker").orderBy("t")
    past = by.rowsBetween(-window, -1)
    rows = panel.withColumn("r", F.log("close") - F.log(F.lag("close").over(by)))
    rows = rows.withColumn("sig", F.when(F.count("r").over(past) == window, F.stddev_samp("r").over(past)))
    rows = rows.withColumn("adv", F.when(F.count("volume").over(past) == window, F.avg("volume").over(past)))
    middle = rows.groupBy("ticker").agg(F.percentile("sig", 0.5).alias("middle"))
    return rows.join(middle, "ticker").withColumn("sig", F.coalesce("sig", "middle")).drop("middle", "r")
