"""Rolling selection with a yearly re-screen: pools of screens, the best pairs of each period, cash where a pool is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import selection

PAIR = ["y", "x"]


def windows(panel: DataFrame, start: int, length: int, every: int, back: int, least_last: int = 20) -> tuple[DataFrame, DataFrame]:
    """(periods, screens): period, lo, hi, screen of each trading period, and screen, lo, hi of each screen's window before it.

    A last period of least_last rows or fewer is left out.  Both tables have a row per period or screen.
    """
    n = panel.agg((F.max("t") + 1).alias("n")).filter("n IS NOT NULL")
    periods = n.select("n", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("n") - start) / length), F.lit(0)).cast("int"))).alias("period"))
    lo = F.lit(start) + F.col("period") * length
    periods = periods.withColumns({"lo": lo, "hi": F.least(lo + length, "n")}).filter(F.col("hi") - F.col("lo") > least_last)
    periods = periods.select("period", "lo", "hi", F.floor(F.col("period") / every).cast("int").alias("screen"))
    screens = periods.groupBy("screen").agg(F.min("lo").alias("hi")).select("screen", (F.col("hi") - back).alias("lo"), "hi")
    return periods, screens


def selection_log(daily: DataFrame, pools: DataFrame, periods: DataFrame, formation: int, k: int, per_ticker: int = 0, metric: str = "f_pnl", least_trades: int = 1, positive: bool = False) -> DataFrame:
    """(period, screen, y, x, screen's columns, f_pnl, f_sharpe, f_trades, next_pnl, next_trades, eligible, formation_rank, selected).

    daily: (y, x, t, pnl, run, held).  Each period's pool is traded; its formation are the formation rows before it.
    """
    w = periods.select("period", "screen", "lo", "hi")
    members = pools.join(F.broadcast(w), "screen")  # a row per period
    rows = members.select("period", "screen", *PAIR, "lo", "hi").join(daily.select(*PAIR, "t", "pnl", "run", "held"), PAIR).filter((F.col("t") >= F.col("lo") - formation) & (F.col("t") < F.col("hi")))
    before = F.col("t") < F.col("lo")
    sums = rows.groupBy("period", *PAIR).agg(
        F.sum(F.when(before, F.col("pnl"))).alias("f_pnl"), (F.avg(F.when(before, F.col("pnl"))) / F.nullif(F.stddev_samp(F.when(before, F.col("pnl"))), F.lit(0.0)) * F.sqrt(F.lit(252.0))).alias("f_sharpe"),
        F.count_distinct(F.when(before & (F.col("held") != 0), F.col("run"))).alias("f_trades"), F.sum(F.when(~before, F.col("pnl"))).alias("next_pnl"),
        F.count_distinct(F.when(~before & (F.col("held") != 0), F.col("run"))).alias("next_trades"),
    )
    log = members.drop("lo", "hi").join(sums, ["period", *PAIR])
    return selection.formation_top_k(log.withColumns({c: F.round(c, 9) for c in ("f_pnl", "f_sharpe", "next_pnl")}), ["period"], metric, k, per_ticker, least_trades, positive)


def period_table(log: DataFrame, periods: DataFrame, k: int, capital: float = 1.0) -> DataFrame:
    """One row per period, cash periods (empty pools) included with zeros."""
    s = F.col("selected")
    sums = log.groupBy("period").agg(
        F.count(F.lit(1)).alias("pool_size"), F.count_if(s).alias("n_selected"), F.sum(F.when(s, F.col("next_pnl"))).alias("sel_net"), F.sum("next_pnl").alias("all_net"),
        F.avg(F.when(s, F.when(F.col("next_pnl") > 0, 1.0).otherwise(0.0))).alias("sel_hit_rate"), F.avg(F.when(~s, F.when(F.col("next_pnl") > 0, 1.0).otherwise(0.0))).alias("unsel_hit_rate"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(s, F.struct("screen_rank", F.concat("y", F.lit("/"), "x").alias("name"))))), lambda p: p["name"]), ", ").alias("names"),
    )
    out = periods.join(sums, "period", "left").na.fill(0, ["pool_size", "n_selected"]).na.fill(0.0, ["sel_net", "all_net"]).na.fill("", ["names"])
    return out.withColumns({"sel_return_pct": 100 * F.col("sel_net") / (capital * k), "all_return_pct": F.when(F.col("pool_size") > 0, 100 * F.col("all_net") / (capital * F.col("pool_size"))).otherwise(0.0)})


def pool_overlaps(pools: DataFrame) -> DataFrame:
    """(screen, n, n_kept): members of each pool, and how many of them the previous screen's pool had (none after an empty one)."""
    before = pools.select((F.col("screen") + 1).alias("screen"), *PAIR, F.lit(1).alias("kept"))
    return pools.join(before, ["screen", *PAIR], "left").groupBy("screen").agg(F.count(F.lit(1)).alias("n"), F.count("kept").alias("n_kept"))


def daily_portfolio(daily: DataFrame, log: DataFrame, periods: DataFrame) -> DataFrame:
    """(t, selected_net, pool_net, selected_cum, pool_cum): every day of every period; days without a position earn 0."""
    rows = log.select("period", *PAIR, "selected").join(F.broadcast(periods.select("period", "lo", "hi")), "period").join(daily.select(*PAIR, "t", "pnl"), PAIR).filter((F.col("t") >= F.col("lo")) & (F.col("t") < F.col("hi")))
    sums = rows.groupBy("t").agg(F.sum(F.when(F.col("selected"), F.col("pnl"))).alias("selected_net"), F.sum("pnl").alias("pool_net"))
    days = periods.select(F.explode(F.sequence("lo", F.col("hi") - 1)).alias("t"))
    out = days.join(sums, "t", "left").na.fill(0.0, ["selected_net", "pool_net"])
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # a row per day
    return out.withColumns({"selected_cum": F.sum("selected_net").over(w), "pool_cum": F.sum("pool_net").over(w)})
