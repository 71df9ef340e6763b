"""Performance of daily profits: fixed-capital statistics, Sharpe and Sortino, drawdowns, growth, periods, trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAYS = 252


def perf_stats(daily: DataFrame, by: list[str], capital: float, net: str = "net", order: str = "t") -> DataFrame:
    """net, return %, yearly return % and volatility %, Sharpe, largest drawdown % of fixed capital."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = daily.withColumn("_eq", F.lit(capital) + F.sum(net).over(w))
    rows = rows.withColumn("_dd", F.col("_eq") / F.max("_eq").over(w) - 1)
    r, sd = F.avg(net) / capital, F.stddev_samp(net) / capital
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"), F.sum(net).alias("net"), (F.sum(net) / capital * 100).alias("return_pct"),
        (r * DAYS * 100).alias("ann_return_pct"), (sd * F.sqrt(F.lit(float(DAYS))) * 100).alias("ann_vol_pct"),
        F.when(sd > 0, r / sd * F.sqrt(F.lit(float(DAYS)))).alias("sharpe"), (F.min("_dd") * 100).alias("max_drawdown_pct"),
    )


def sharpe_sortino(daily: DataFrame, by: list[str], ret: str) -> DataFrame:
    """Yearly Sharpe (null if flat), volatility and Sortino (infinite without losses and with gains)."""
    down = F.sqrt(F.avg(F.when(F.col(ret) < 0, F.col(ret) * F.col(ret))))
    mean, sd, root = F.avg(ret), F.stddev_samp(ret), F.sqrt(F.lit(float(DAYS)))
    out = daily.groupBy(*by).agg(F.count(ret).alias("n"), mean.alias("m"), sd.alias("sd"), down.alias("down"))
    return out.select(
        *by, "n", F.when((F.col("n") >= 2) & (F.col("sd") > 1e-12), F.col("m") / F.col("sd") * root).alias("sharpe"), (F.col("sd") * root).alias("vol"),
        F.when(F.col("down") > 0, F.col("m") / F.col("down") * root).when(F.col("m") > 0, F.lit(float("inf"))).alias("sortino"),
    )


def drawdowns(equity: DataFrame, by: list[str], value: str, order: str = "t") -> DataFrame:
    """Largest drawdown (at least -1) and longest run of rows under the last high."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = equity.withColumn("_dd", F.col(value) / F.max(value).over(w) - 1)
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_dd") < 0, 0).otherwise(1)).over(w))
    runs = rows.groupBy(*by, "_run").agg(F.min("_dd").alias("low"), F.count_if(F.col("_dd") < 0).alias("under"))
    return runs.groupBy(*by).agg(F.greatest(F.min("low"), F.lit(-1.0)).alias("max_drawdown"), F.max("under").alias("longest_under"))


def cagr(equity: DataFrame, by: list[str], value: str, order: str = "date") -> DataFrame:
    """Growth a year from the first to the last value over calendar days."""
    out = equity.groupBy(*by).agg(F.min(F.struct(order, value)).alias("a"), F.max(F.struct(order, value)).alias("b"))
    days = F.datediff(F.col(f"b.{order}"), F.col(f"a.{order}"))
    growth = F.col(f"b.{value}") / F.col(f"a.{value}")
    return out.select(*by, days.alias("days"), F.when((days > 0) & (growth > 0), F.pow(growth, F.lit(365.25) / days) - 1).alias("cagr"))


def period_returns(equity: DataFrame, by: list[str], value: str, pattern: str, order: str = "date") -> DataFrame:
    """Compounded returns per calendar period ('yyyy-MM' or 'yyyy'); the first return is 0.  Products telescope: no logarithms."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = equity.withColumn("_r", F.coalesce(F.col(value) / F.lag(value).over(w) - 1, F.lit(0.0))).withColumn("period", F.date_format(order, pattern))
    return rows.groupBy(*by, "period").agg((F.product(1 + F.col("_r")) - 1).alias("ret"), F.count(F.lit(1)).alias("n_days"))


def trade_stats(trades: DataFrame, by: list[str], net: str = "net", held: str = "days_held") -> DataFrame:
    """Counts, win rate, mean win and loss, profit factor, expectancy, holding, worst loss (0 if none)."""
    n = F.col(net)
    out = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg(F.when(n > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg(F.when(n > 0, n)).alias("avg_win"),
        F.avg(F.when(n < 0, n)).alias("avg_loss"), F.coalesce(F.sum(F.when(n > 0, n)), F.lit(0.0)).alias("won"), F.coalesce(F.sum(F.when(n < 0, -n)), F.lit(0.0)).alias("lost"),
        F.avg(n).alias("expectancy"), F.avg(held).alias("avg_days"), F.least(F.coalesce(F.min(n), F.lit(0.0)), F.lit(0.0)).alias("worst"),
    )
    factor = F.when(F.col("lost") > 0, F.col("won") / F.col("lost")).when(F.col("won") > 0, F.lit(float("inf")))
    return out.withColumn("profit_factor", factor).drop("won", "lost")
