"""Per-pair statistics over a whole series: unit roots, cointegration, Johansen, stationarity, their share over windows, Kalman hedges.

All but the Kalman filter are column expressions (``unitroot.py``): one shuffle by group, nothing outside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.native import eg_p
from . import unitroot


def screen(rows: DataFrame, by: list[str], y: str = "ly", x: str = "lx", least: int = 30, autolag: str | None = "aic") -> DataFrame:
    """Cointegration statistics of each group; null statistics under `least` rows or where a series does not vary."""
    w = Window.partitionBy(*by).orderBy("t")
    s = unitroot.johansen_series(unitroot.residuals(rows, by, y, x), w, y, x)
    enough = F.col("n") >= least
    out = s.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("n"), F.first("alpha").alias("alpha"), F.first("beta").alias("beta"), unitroot.series_of("t", "s").alias("_s"), *unitroot.johansen_moments())
    out = out.withColumns({"_s": F.when(enough, F.col("_s")), "_j_n": F.when(enough, F.col("_j_n"))})
    out = unitroot.dickey_fuller(unitroot.dickey_fuller(out, "_s", "eg_tau", rule=autolag), "_s", "adf_tau", constant=True)
    out = unitroot.johansen(unitroot.kpss(out, "_s", "kpss"))
    ok = F.when(F.col("johansen_trace").isNotNull(), F.col("johansen_ok"))
    return out.select(
        *by, "eg_tau", F.col("eg_tau_lag").alias("eg_lag"), eg_p(F.col("eg_tau")).alias("eg_p"), "adf_tau", unitroot.adf_p(F.col("adf_tau")).alias("adf_p"), F.col("kpss").alias("kpss_stat"), "kpss_p",
        "johansen_trace", "johansen_eigen", "johansen_trace_ratio", "johansen_hedge", ok.alias("johansen_ok"), "alpha", "beta", "n",
    )


def pass_rates(rows: DataFrame, by: list[str], count: int, alpha: float, least: int | Column, y: str, x: str, autolag: str | None = "aic") -> DataFrame:
    """(by, n_windows, pass_rate, mean_p): share of `count` evenly placed windows of a group in which Engle-Granger rejects.

    A window has max(least, n div count) of the group's n rows (column _n in least); starts that coincide count once, failed
    tests not at all.  A group whose window would cover all its rows has no row.
    """
    w = Window.partitionBy(*by)
    rows = rows.select(*by, "t", y, x).withColumns({"_n": F.count(F.lit(1)).over(w), "_i": F.row_number().over(w.orderBy("t")) - 1})
    rows = rows.withColumn("_w", F.greatest(F.lit(least) if isinstance(least, int) else least, F.floor(F.col("_n") / max(count, 1))).cast("int"))
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(max(count - 1, 0))), lambda i: F.floor(i * (F.col("_n") - F.col("_w")) / max(count - 1, 1)).cast("int")))
    # a row goes only to the windows that hold it
    mine = F.filter(at, lambda start: (F.col("_i") >= start) & (F.col("_i") < start + F.col("_w")))
    part = rows.filter(F.col("_w") < F.col("_n")).select(*by, "t", y, x, F.explode(mine).alias("_start"))
    key = [*by, "_start"]
    tested = unitroot.dickey_fuller(unitroot.residuals(part, key, y, x).groupBy(*key).agg(unitroot.series_of("t", "s").alias("_s")), "_s", "tau", rule=autolag).withColumn("p", eg_p(F.col("tau")))
    return tested.groupBy(*by).agg(F.count("p").alias("n_windows"), F.avg(F.when(F.col("p").isNotNull(), F.when(F.col("p") <= alpha, 1.0).otherwise(0.0))).alias("pass_rate"), F.avg("p").alias("mean_p"))


def pass_rate(rows: DataFrame, count: int = 4, alpha: float = 0.05, least: int = 100) -> DataFrame:
    """pass_rates of each pair's log prices."""
    return pass_rates(rows, ["y", "x"], count, alpha, least, "ly", "lx")


def kalman_hedge(rows: DataFrame, by: list[str], delta: float = 1e-5, noise: float | None = None) -> DataFrame:
    from .simulate import fold

    return fold(rows, by, lambda y, x: stats.kalman(y, x, delta, noise), ["py", "px"], {"alpha": "double", "beta": "double"})
