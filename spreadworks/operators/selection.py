"""Pools of pairs: filters, scores, greedy walks with a cap per ticker, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import capped_top_k, percent_rank_of


def pool(metrics: DataFrame, by: list[str], n: int = 50, per_ticker: int = 5, min_half_life: float = 2.0, max_half_life: float = 60.0, max_p: float = 1.0, gate_fdr: float | None = None,
         gate_johansen: bool = False, gate_kpss: bool = False, min_stability: float = 0.0, min_edge_ratio: float = 0.0, score: str = "composite") -> DataFrame:
    """The pool of each screen: filtered metrics with pool_score, walked from the best on, at most per_ticker pairs of a ticker, n in all.

    score: composite (mean of four percentile ranks), net_edge or tstat.  gate_fdr filters on the corrected p where it is given.
    """
    d = metrics.filter(F.col("half_life").between(min_half_life, max_half_life) & (F.col("eg_pvalue") <= max_p))
    if gate_fdr is not None:
        d = d.filter(F.col("eg_pvalue_fdr") < gate_fdr)
    if gate_johansen:
        d = d.filter(F.coalesce("johansen_ok", F.lit(False)))
    if gate_kpss:
        d = d.filter(F.col("kpss_pvalue") > 0.05)
    if min_stability > 0:
        d = d.filter(F.col("stability") >= min_stability)
    if min_edge_ratio > 0:
        d = d.filter(F.col("edge_ratio") >= min_edge_ratio)
    return capped_top_k(scored(d, by, score), by, "pool_score", n, per_ticker).withColumnRenamed("place", "screen_rank")


def scored(d: DataFrame, by: list[str], score: str = "composite") -> DataFrame:
    """Adds pool_score, rounded to nine digits so that equal scores tie."""
    value = {
        "tstat": lambda: -F.col("eg_tstat"),
        "net_edge": lambda: F.col("net_edge_bps_per_year"),
        "composite": lambda: (percent_rank_of("net_edge_bps_per_year", by) + percent_rank_of("stability", by) + percent_rank_of("crossings_per_year", by) + percent_rank_of("half_life", by, descending=True)) / 4,
    }[score]()
    return d.withColumn("pool_score", F.round(value, 9))


def picked_candidates(screened: DataFrame, by: list[str], n: int = 50, per_ticker: int = 5, min_half_life: float = 2.0, max_half_life: float = 60.0, ratio: str | None = "johansen_ratio") -> DataFrame:
    """Candidates of a one-shot screen: percentile rank of p plus that of the (negated) trace ratio, the least first, with a cap per ticker."""
    d = screened.filter(F.col("half_life").between(min_half_life, max_half_life))
    score = percent_rank_of("p", by)
    if ratio:
        score = score + percent_rank_of(ratio, by, descending=True)
    d = d.withColumn("sel_score", F.round(score, 9)).withColumn("_up", -F.col("sel_score"))
    return capped_top_k(d, by, "_up", n, per_ticker).drop("_up")


def drifted(pool_: DataFrame, rows: DataFrame, most: float = 1e-6) -> DataFrame:
    """Pairs of a pool whose hedge ratio differs from the one fitted on rows: another split was used (look-ahead)."""
    fitted = rows.groupBy("y", "x").agg(F.regr_slope("ly", "lx").alias("fitted"))
    return pool_.join(fitted, ["y", "x"]).filter(F.abs(F.col("hedge_ratio") - F.col("fitted")) > most).select("y", "x", "hedge_ratio", "fitted")


def formation_top_k(formed: DataFrame, by: list[str], metric: str, k: int, per_ticker: int = 0, least_trades: int = 1, positive: bool = False) -> DataFrame:
    """Adds eligible, formation_rank (of the whole pool) and selected: the best k eligible pairs of a period, missing metrics last.

    The greedy walk with a cap sees only eligible pairs: one period's pool.
    """
    eligible = F.col("f_trades") >= least_trades
    if positive:
        eligible = eligible & (F.col("f_pnl") > 0)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(metric).desc_nulls_last(), "y", "x"))
    rows = formed.withColumns({"eligible": F.coalesce(eligible, F.lit(False)), "formation_rank": rank})
    good = rows.filter("eligible")
    if per_ticker:
        chosen = capped_top_k(good.select(*by, "y", "x", metric), by, metric, k, per_ticker).select(*by, "y", "x", F.lit(True).alias("selected"))
        return rows.join(chosen, [*by, "y", "x"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    place = F.row_number().over(Window.partitionBy(*by, "eligible").orderBy(F.col(metric).desc_nulls_last(), F.col("f_pnl").desc_nulls_last(), "y", "x"))
    return rows.withColumn("selected", F.col("eligible") & (place <= k))


def pair_summary(log: DataFrame, value: str = "next_pnl") -> DataFrame:
    """(y, x, periods_selected, net_pnl, periods_profitable) of the selected rows of a log."""
    return log.filter("selected").groupBy("y", "x").agg(F.count(F.lit(1)).alias("periods_selected"), F.sum(value).alias("net_pnl"), F.count_if(F.col(value) > 0).alias("periods_profitable"))
