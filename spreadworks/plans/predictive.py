"""Do screen metrics predict forward returns?  A panel (period, y, x, grp, metrics, outcomes) and the tables of its study.

Metrics and outcomes become rows (metric, outcome), so every table is one job over all
of them.  Missing values take no part: not in ranks, not in regressions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.native import normal_two_sided
from ..operators import ranking, research

PAIR = ["y", "x"]
#: What each reason of an exit is called.
EXITS = ("target", "stop", "time", "end_of_window")


def long(panel: DataFrame, metrics: list[str], outcomes: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(period, y, x, grp, metric, value, outcome, ret) rows; nulls stay nulls."""
    rows = panel.select("period", *PAIR, "grp", *keep, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m"), *outcomes)
    rows = rows.select("period", *PAIR, "grp", *keep, "m.metric", "m.value", F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("ret")) for o in outcomes])).alias("o"))
    return rows.select("period", *PAIR, "grp", *keep, "metric", "value", "o.outcome", "o.ret")


def ic_table(rows: DataFrame, least: int = 8) -> DataFrame:
    """(metric, outcome, n_periods, ic, t, p, share_positive, p_holm): rank correlations of the periods and their mean's test."""
    ics = ranking.rank_ic(rows, ["metric", "outcome", "period"], "value", "ret", least).filter("ic IS NOT NULL")
    share = ics.groupBy("metric", "outcome").agg(F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("share_positive"))
    found = research.t_summary(ics, ["metric", "outcome"], "ic").join(share, ["metric", "outcome"])
    out = ranking.corrected(found, ["outcome"], "p", ["metric"])
    return out.select("metric", "outcome", F.col("n").alias("n_periods"), F.col("mean").alias("ic"), "t", "p", "share_positive", "p_holm")


def quintile_table(rows: DataFrame, least: int = 10, least_periods: int = 3) -> DataFrame:
    """(metric, outcome, n_periods, q1..q5, spread, t, p): mean returns by quintile, averaged over periods; spread is Q5 - Q1."""
    by = ["metric", "outcome", "period"]
    good = research.complete(rows, "value", "ret").withColumn("q", ranking.quintile("value", by, 5, least)).filter("q IS NOT NULL")
    per = good.groupBy(*by).agg(*[F.avg(F.when(F.col("q") == k, F.col("ret"))).alias(f"q{k}") for k in range(1, 6)])
    per = per.withColumn("spread", F.col("q5") - F.col("q1"))
    means = per.groupBy("metric", "outcome").agg(F.count(F.lit(1)).alias("n_periods"), *[F.avg(f"q{k}").alias(f"q{k}") for k in range(1, 6)]).filter(F.col("n_periods") >= least_periods)
    return means.join(research.t_summary(per, ["metric", "outcome"], "spread").withColumnRenamed("mean", "spread").drop("n"), ["metric", "outcome"])


def standardized(rows: DataFrame) -> DataFrame:
    """z: value within its period (population deviation; null without variation); r: return less its period's mean over all pairs."""
    w = Window.partitionBy("metric", "outcome", "period")
    return rows.withColumns({"z": ranking.zscore_within("value", ["metric", "outcome", "period"]), "r": F.col("ret") - F.avg("ret").over(w)})


def regressions(rows: DataFrame, least: int = 30, least_periods: int = 4) -> DataFrame:
    """(metric, outcome, n, coef, se, t, p): return for one deviation of each metric, errors clustered by period and pair."""
    out = research.clustered_slope(standardized(rows), "z", "r", ["period"], PAIR, ["metric", "outcome"])
    return out.filter((F.col("n") >= least) & (F.col("n_one") >= least_periods)).drop("n_one")


def joint_regression(panel: DataFrame, metrics: list[str], outcome: str, least: int = 30) -> DataFrame:
    """(metric, n, coef, se, t, p) of one regression on all metrics.

    The k x k normal equations and the three cluster sums are aggregates of one row each; only these k * k numbers reach the driver.
    """
    spark, k = panel.sparkSession, len(metrics)
    w = Window.partitionBy("period")
    rows = panel.select("period", *PAIR, (F.col(outcome) - F.avg(outcome).over(w)).alias("r"), *[ranking.zscore_within(m, ["period"]).alias(f"z{i}") for i, m in enumerate(metrics)])
    rows = research.complete(rows, "r", *[f"z{i}" for i in range(k)])
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"z{i}") * F.col("r")).alias(f"y{i}") for i in range(k)], *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    schema = "metric string, n long, coef double, se double, t double"
    if sums["n"] <= least:
        return spark.createDataFrame([], schema).withColumn("p", F.lit(None).cast("double"))
    xx = np.array([[sums[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    inverse = np.linalg.pinv(xx)
    coef = inverse @ np.array([sums[f"y{i}"] for i in range(k)])
    residual = F.col("r") - sum((F.col(f"z{i}") * F.lit(float(coef[i])) for i in range(k)), F.lit(0.0))
    scores = rows.select("period", *PAIR, *[(F.col(f"z{i}") * residual).alias(f"u{i}") for i in range(k)])
    groups = scores.groupingSets([["period"], PAIR, ["period", *PAIR]], "period", *PAIR).agg(*[F.sum(f"u{i}").alias(f"u{i}") for i in range(k)], F.grouping_id().alias("g"))
    meat = groups.groupBy("g").agg(F.count(F.lit(1)).alias("c"), *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).collect()
    n, total = sums["n"], np.zeros((k, k))
    for r in meat:
        part = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        total += (-1 if r["g"] == 0 else 1) * part * (r["c"] / (r["c"] - 1) if r["c"] > 1 else np.nan) * ((n - 1) / (n - k))
    variance = np.diag(inverse @ total @ inverse)
    out = [(m, n, float(c), float(np.sqrt(v)) if v > 0 else None, float(c / np.sqrt(v)) if v > 0 else None) for m, c, v in zip(metrics, coef, variance, strict=True)]
    return spark.createDataFrame(out, schema).withColumn("p", normal_two_sided(F.col("t")))


def gate_table(panel: DataFrame, gates: list[str], outcomes: list[str]) -> DataFrame:
    """(gate, outcome, n_pass, n_fail, mean_pass, mean_fail, diff, t, p): pairs that pass against the others of the same period and group.

    Only cells (period, group) in which the gate varies count.
    """
    rows = research.complete(long(panel, gates, outcomes), "value", "ret").filter("grp IS NOT NULL")
    cell = Window.partitionBy("metric", "outcome", "period", "grp")
    rows = rows.withColumn("_sd", F.stddev_samp("value").over(cell)).filter("_sd > 0")
    rows = rows.withColumns({"v": F.col("value") - F.avg("value").over(cell), "r": F.col("ret") - F.avg("ret").over(cell)})
    fit = research.clustered_slope(rows, "v", "r", ["period"], PAIR, ["metric", "outcome"])
    passed = F.col("value") == 1
    counts = rows.groupBy("metric", "outcome").agg(
        F.count_if(passed).alias("n_pass"), F.count_if(F.col("value") == 0).alias("n_fail"), F.avg(F.when(passed, F.col("ret"))).alias("mean_pass"), F.avg(F.when(F.col("value") == 0, F.col("ret"))).alias("mean_fail")
    )
    return counts.join(fit, ["metric", "outcome"]).select(F.col("metric").alias("gate"), "outcome", "n_pass", "n_fail", "mean_pass", "mean_fail", F.col("coef").alias("diff"), "t", "p")


def conditional_table(panel: DataFrame, metrics: list[str], outcomes: list[str]) -> DataFrame:
    """IC and quintiles over the pair-periods that traded."""
    rows = long(panel.filter("next_trades > 0"), metrics, outcomes)
    n = panel.filter("next_trades > 0").agg(F.count(F.lit(1)).alias("n_traded"))
    q = quintile_table(rows)
    ic = ic_table(rows).select("metric", "outcome", "ic", F.col("t").alias("ic_t"))
    return q.join(ic, ["metric", "outcome"], "left").crossJoin(F.broadcast(n))  # one row


def exit_counts(trades: DataFrame, by: list[str], reason: str = "why", net: str = "net", days: str = "days_held") -> DataFrame:
    """Per key: trades, profit, wins and days of each reason, and in all."""
    out = [F.count(F.lit(1)).alias("next_trades"), F.count_if(F.col(net) > 0).alias("n_wins"), F.sum(days).alias("days_total")]
    for e in EXITS:
        here = F.col(reason) == e
        out += [F.count_if(here).alias(f"n_{e}"), F.coalesce(F.sum(F.when(here, F.col(net))), F.lit(0.0)).alias(f"pnl_{e}"), F.count_if(here & (F.col(net) > 0)).alias(f"win_{e}"), F.coalesce(F.sum(F.when(here, F.col(days))), F.lit(0)).alias(f"days_{e}")]
    return trades.groupBy(*by).agg(*out)


def exit_quintiles(panel: DataFrame, metrics: list[str], least: int = 10) -> DataFrame:
    """By metric and quintile: how often pairs trade, how trades end, what each kind of exit earns."""
    extra = ("next_trades", "n_wins", "days_total", "next_net", *[f"n_{e}" for e in EXITS], *[f"pnl_{e}" for e in EXITS])
    rows = long(panel, metrics, ["next_net"], extra).filter("value IS NOT NULL")
    rows = rows.withColumn("q", ranking.quintile("value", ["metric", "period"], 5, least)).filter("q IS NOT NULL")
    trades = F.nullif(F.sum("next_trades"), F.lit(0))
    return rows.groupBy("metric", "q").agg(
        F.count(F.lit(1)).alias("n_pair_periods"), F.avg(F.when(F.col("next_trades") > 0, 1.0).otherwise(0.0)).alias("traded_share"), F.avg("next_trades").alias("trades_per_pair"),
        (F.sum("n_wins") / trades).alias("win_rate"), (F.sum("days_total") / trades).alias("avg_days"), (F.sum("next_net") / trades).alias("net_per_trade"),
        *[(F.sum(f"n_{e}") / trades).alias(f"{e}_share") for e in EXITS], *[F.avg(f"pnl_{e}").alias(f"mean_pnl_{e}") for e in EXITS],
    )


def exit_summary(panel: DataFrame) -> DataFrame:
    """(exit_reason, n_trades, share, win_rate, avg_days, net_per_trade, total_net) over all pair-periods: an unpivot of its counts."""
    one = panel.select(F.explode(F.array(*[F.struct(F.lit(e).alias("exit_reason"), F.col(f"n_{e}").alias("n"), F.col(f"win_{e}").alias("w"), F.col(f"days_{e}").alias("d"), F.col(f"pnl_{e}").alias("v")) for e in EXITS])).alias("e")).select("e.*")
    out = one.groupBy("exit_reason").agg(F.sum("n").alias("n_trades"), F.sum("w").alias("w"), F.sum("d").alias("d"), F.sum("v").alias("total_net"))
    n = F.nullif("n_trades", F.lit(0))
    every = F.nullif(F.sum("n_trades").over(Window.partitionBy(F.lit(1))), F.lit(0))  # four rows
    return out.select("exit_reason", "n_trades", (F.col("n_trades") / every).alias("share"), (F.col("w") / n).alias("win_rate"), (F.col("d") / n).alias("avg_days"), (F.col("total_net") / n).alias("net_per_trade"), "total_net")
