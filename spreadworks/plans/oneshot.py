"""One-shot screen of all pairs: what the training rows say, and whether it holds on the test rows.

The training fit is looked at three ways on the test rows, in one pass over them: frozen
(hedge, mean and deviation of the training rows), refitted (each block of step rows uses a
fit on the rows before it) and anew (tests of rolling windows and a fresh Johansen fit).
Fits are aggregates that join the test rows by pair and by (pair, block); a pair's test
rows meet in one group once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.native import eg_p
from ..operators import rolling, tradability, unitroot
from ..operators.intervals import within
from ..operators.ranking import corrected, percent_rank_of
from .lineage import cut

PAIR = ["y", "x"]
YEAR = 252


def split_at(panel: DataFrame, train_share: float = 0.6, train_end: str | None = None) -> DataFrame:
    """(n, n_train) of a panel, in one row: rows by position, the first share of them (or those up to a date) for training."""
    n = F.max("t") + 1
    upto = F.floor(n * train_share) if train_end is None else F.max(F.when(F.col("date") <= F.lit(train_end).cast("date"), F.col("t"))) + 1
    return panel.agg(n.cast("int").alias("n"), F.coalesce(upto, F.lit(0)).cast("int").alias("n_train")).filter("n > n_train AND n_train > 0")


def refits(rows: DataFrame, split: DataFrame, step: int, lookback: int = 0) -> DataFrame:
    """(y, x, block, wf_alpha, wf_beta, wf_sd): fits of the lookback (0: as many as the training has) rows before each block of step test rows."""
    back = F.col("n_train") if lookback <= 0 else F.lit(lookback)
    last = F.floor((F.col("n") - F.col("n_train") - 1) / step).cast("int")
    blocks = split.select("n_train", F.explode(F.sequence(F.lit(0), last)).alias("block"), back.alias("back"))
    start = F.col("n_train") + F.col("block") * step
    blocks = blocks.select("block", F.greatest(start - F.col("back"), F.lit(0)).alias("lo"), start.alias("hi"))
    fits = within(rows.select(*PAIR, "t", "ly", "lx"), blocks).groupBy(*PAIR, "block").agg(
        F.regr_slope("ly", "lx").alias("wf_beta"), F.regr_intercept("ly", "lx").alias("wf_alpha"), F.count(F.lit(1)).alias("m"), F.regr_syy("ly", "lx").alias("yy"), F.regr_sxx("ly", "lx").alias("xx"), F.regr_sxy("ly", "lx").alias("xy"),
    )
    rest = (F.col("yy") - F.col("xy") * F.col("xy") / F.nullif(F.col("xx"), F.lit(0.0))) / F.nullif(F.col("m") - 1, F.lit(0))
    return fits.select(*PAIR, "block", "wf_alpha", "wf_beta", F.sqrt(F.greatest(rest, F.lit(0.0))).alias("wf_sd"))


def trained(rows: DataFrame, min_corr: float = -1.0, autolag: str | None = "aic", with_hurst: bool = True) -> DataFrame:
    """What the training rows (y, x, t, ly, lx) of each pair say; pairs without a correlation of returns, or one below min_corr, have no row."""
    w = Window.partitionBy(*PAIR).orderBy("t")
    s = unitroot.residuals(rows, PAIR).withColumns({"dy": F.col("ly") - F.lag("ly").over(w), "dx": F.col("lx") - F.lag("lx").over(w)})
    s = unitroot.johansen_series(s.withColumn("s0", F.lag("s").over(w)).withColumn("ds", F.col("s") - F.col("s0")), w, "ly", "lx")
    out = s.groupBy(*PAIR).agg(
        F.corr("dy", "dx").alias("train_return_corr"), F.first("beta").alias("hedge_ratio"), F.first("alpha").alias("intercept"), F.stddev_samp("s").alias("train_spread_sd"),
        F.regr_slope("ds", "s0").alias("k"), unitroot.series_of("t", "s").alias("_s"), *unitroot.johansen_moments(),
    )
    out = out.filter((F.col("train_return_corr") >= min_corr) & ~F.isnan("train_return_corr"))
    out = unitroot.dickey_fuller(unitroot.dickey_fuller(out, "_s", "eg_tau", rule=autolag), "_s", "adf_tau", constant=True).drop("_s")
    out = unitroot.johansen(out, "train_johansen")
    out = out.withColumns({"train_eg_p": eg_p(F.col("eg_tau")), "train_adf_p": unitroot.adf_p(F.col("adf_tau")), "train_half_life": tradability.half_life_of(F.col("k")), "train_johansen_ok": F.coalesce("train_johansen_ok", F.lit(False))})
    out = out.drop("k", "eg_tau", "eg_tau_lag", "adf_tau", "adf_tau_lag").withColumnRenamed("train_johansen_hedge", "johansen_hedge_ratio")
    if with_hurst:
        out = out.join(rolling.hurst(s.select(*PAIR, "t", F.col("s").alias("spread"))).withColumnRenamed("hurst", "train_hurst"), PAIR, "left")
    return out


def tried(rows: DataFrame, fits: DataFrame, blocks: DataFrame, step: int, with_hurst: bool = True) -> DataFrame:
    """What the test rows (y, x, t, n_train, ly, lx) of each pair say of its training fit and of its refits."""
    w = Window.partitionBy(*PAIR).orderBy("t")
    frozen = fits.select(*PAIR, "hedge_ratio", "intercept", "train_spread_sd")
    s = rows.withColumn("block", F.floor((F.col("t") - F.col("n_train")) / step).cast("int")).join(frozen, PAIR).join(blocks, [*PAIR, "block"])
    s = s.withColumns({"s": F.col("ly") - F.col("intercept") - F.col("hedge_ratio") * F.col("lx"), "v": (F.col("ly") - F.col("wf_alpha") - F.col("wf_beta") * F.col("lx")) / F.nullif("wf_sd", F.lit(0.0))})
    s = s.withColumns({"z": F.col("s") / F.nullif("train_spread_sd", F.lit(0.0)), "s0": F.lag("s").over(w), "v0": F.lag("v").over(w), "first": F.lag("block").over(w).isNull() | (F.lag("block").over(w) != F.col("block"))})
    s = unitroot.johansen_series(s, w, "ly", "lx").withColumn("z0", F.lag("z").over(w))
    crossed = lambda now, before: F.count_if(F.col(before).isNotNull() & ((F.col(now) < 0) != (F.col(before) < 0))) * YEAR / F.count(F.lit(1))
    inside = lambda v: F.avg(F.when(F.abs(v) < 2, 1.0).otherwise(0.0))
    beta = F.when(F.col("first"), F.col("wf_beta"))
    out = s.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("test_rows"), (F.avg("s") / F.first("train_spread_sd")).alias("test_mean_shift_in_train_sd"), (F.stddev_samp("s") / F.first("train_spread_sd")).alias("test_sd_ratio"),
        F.max(F.abs("z")).alias("test_max_abs_z"), inside("z").alias("test_share_within_2sd"), crossed("z", "z0").alias("test_crossings_per_year"), F.regr_slope(F.col("s") - F.col("s0"), F.col("s0")).alias("k"),
        F.max(F.abs("v")).alias("wf_max_abs_z"), inside("v").alias("wf_share_within_2sd"), crossed("v", "v0").alias("wf_crossings_per_year"), F.regr_slope(F.col("v") - F.col("v0"), F.col("v0")).alias("kv"),
        F.avg(beta).alias("wf_beta_mean"), F.stddev_pop(beta).alias("wf_beta_sd"), (F.avg(beta) - F.first("hedge_ratio")).alias("wf_beta_drift"), F.count_if(F.signum(beta) != F.signum("hedge_ratio")).alias("wf_beta_sign_flips"),
        unitroot.series_of("t", "s").alias("_s"), unitroot.series_of("t", "v").alias("_v"), *unitroot.johansen_moments(),
    )
    out = unitroot.dickey_fuller(unitroot.dickey_fuller(out, "_s", "tau", constant=True), "_v", "wf_tau", constant=True).drop("_s", "_v")
    out = unitroot.johansen(out, "test_johansen")
    out = out.withColumns({"test_adf_p": unitroot.adf_p(F.col("tau")), "wf_adf_p": unitroot.adf_p(F.col("wf_tau")), "test_half_life": tradability.half_life_of(F.col("k")), "wf_half_life": tradability.half_life_of(F.col("kv")), "test_johansen_ok": F.coalesce("test_johansen_ok", F.lit(False))})
    out = out.drop("k", "kv", "tau", "tau_lag", "wf_tau", "wf_tau_lag", "test_johansen_trace", "test_johansen_eigen", "test_johansen_hedge")
    if with_hurst:
        out = out.join(rolling.hurst(s.select(*PAIR, "t", F.col("s").alias("spread"))).withColumnRenamed("hurst", "test_hurst"), PAIR, "left")
    return out


def screened(rows: DataFrame, split: DataFrame, step: int = 63, lookback: int = 0, alpha: float = 0.05, screen_p: float = 0.10, min_corr: float = -1.0, roll_window: int = 126, roll_step: int = 21,
             autolag: str | None = "aic", with_hurst: bool = True) -> DataFrame:
    """One row per pair: training and test statistics, flags of what persisted, rank_score (the less the better) and place.

    rows: (y, x, t, ly, lx); split: (n, n_train), one row.  A missing p counts as 1 in the correction and fails its flags;
    a pair whose training p is above screen_p has no rolling test, which ranks as a share of 0.  Ties of place go by y and x.
    """
    all_rows = rows.select(*PAIR, "t", "ly", "lx").crossJoin(F.broadcast(split.select("n_train")))  # one row
    fits = cut(trained(all_rows.filter("t < n_train").drop("n_train"), min_corr, autolag, with_hurst))  # a row per pair, read three times
    test = all_rows.filter("t >= n_train")
    out = fits.join(tried(test, fits, refits(rows, split, step, lookback), step, with_hurst), PAIR)
    rolled = tradability.persistence(test.select(*PAIR, "t", "ly", "lx"), fits.select(*PAIR, F.col("train_eg_p").alias("p")), roll_window, roll_step, alpha, screen_p)
    out = out.join(rolled.select(*PAIR, F.col("n_windows").alias("roll_n_windows"), F.col("share_cointegrated").alias("roll_share_cointegrated"), F.col("mean_p").alias("roll_mean_p")), PAIR, "left")
    out = corrected(out.withColumn("all", F.lit(1)), ["all"], "train_eg_p", PAIR, null_is_one=True).withColumnRenamed("p_bh", "train_eg_p_fdr").drop("p_bonferroni", "p_holm")
    under = lambda c: F.coalesce(F.col(c) < alpha, F.lit(False))
    out = out.withColumns({"cointegrated_train": under("train_eg_p"), "cointegrated_train_fdr": under("train_eg_p_fdr"), "stationary_test": under("test_adf_p"), "stationary_wf": under("wf_adf_p")})
    both = lambda a, b: F.col(a) & F.col(b)
    out = out.withColumns({
        "persisted": both("cointegrated_train", "stationary_test"), "persisted_fdr": both("cointegrated_train_fdr", "stationary_test"), "persisted_wf_fdr": both("cointegrated_train_fdr", "stationary_wf"),
        "eg_and_johansen_train": both("cointegrated_train_fdr", "train_johansen_ok"), "_roll": F.coalesce("roll_share_cointegrated", F.lit(0.0)),
    })
    out = out.withColumn("persisted_strict", F.col("persisted_fdr") & F.col("persisted_wf_fdr") & F.col("eg_and_johansen_train"))
    # equal values tie whatever their last digits
    ranked = {"_r1": "train_eg_p", "_r2": "test_adf_p", "_r3": "wf_adf_p", "_r4": "_roll"}
    out = out.withColumns({k: F.round(v, 9) for k, v in ranked.items()})
    score = percent_rank_of("_r1", ["all"]) + percent_rank_of("_r2", ["all"]) + percent_rank_of("_r3", ["all"]) + 1 - percent_rank_of("_r4", ["all"])
    out = out.withColumn("rank_score", F.round(score, 9))
    order = Window.partitionBy("all").orderBy(F.desc("persisted_strict"), F.desc("persisted_fdr"), F.desc("persisted"), F.col("rank_score").asc_nulls_last(), *PAIR)  # a row per pair
    return out.withColumn("place", F.row_number().over(order)).drop("all", "_roll", *ranked)
