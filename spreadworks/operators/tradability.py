"""Screens of whole pair universes over many windows at once: does a pair exist, how often would it trade, is a trade worth its cost.

A table of windows (screen, lo, hi: as many rows as screen dates) is joined to the pair
rows by position; screen is a further key of every step, so all screens are one job with
one shuffle.  The Engle-Granger statistic has its lags chosen by AIC (``unitroot.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.native import eg_p
from . import unitroot
from .intervals import within
from .ranking import corrected
from .screens import pass_rates
from .tasks import spread
from .unitroot import residuals, series_of

KEY = ["screen", "y", "x"]
DAYS = 252.0


def in_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of each window (screen, lo, hi): a row serves every window that covers it.  windows: a row per screen date."""
    return within(rows, windows)


def half_life_of(slope):
    """-ln 2 / ln(1 + slope), null unless 0 < 1 + slope < 1."""
    return F.when((slope > -1) & (slope < 0), -F.log(F.lit(2.0)) / F.log1p(slope))


def tradability(rows: DataFrame, windows: DataFrame, entry: float = 2.0, leave: float = 0.5, parts: int = 3, min_half_life: float = 2.0, max_half_life: float = 60.0,
                min_corr: float = -1.0, half_spread_bps: float = 2.0, sell_fee_bps: float = 0.3, comm_share: float = 0.0035, borrow_bps: float = 50.0, autolag: str | None = "aic",
                johansen: bool = False, kpss: bool = False) -> DataFrame:
    """One row per screen and pair with its existence test, activity, costs, edge and stability over parts of the window.

    johansen and kpss: also those tests (johansen_ok, johansen_trace_ratio; kpss_pvalue of the residuals).

    Pairs without a correlation, or one below min_corr, take no part.  A missing half-life makes cost and edge null.
    """
    w = Window.partitionBy(*KEY).orderBy("t")
    every = Window.partitionBy(*KEY)
    rows = residuals(in_windows(rows.select("y", "x", "grp", "t", "py", "px", "ly", "lx"), windows), KEY)
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(every), "i": F.row_number().over(w) - 1, "dy": F.col("ly") - F.lag("ly").over(w), "dx": F.col("lx") - F.lag("lx").over(w), "s0": F.lag("s").over(w)})
    part = F.lit(0)
    for c in range(1, parts):
        part = part + F.when(F.col("i") >= F.floor(F.col("n") * c / parts), 1).otherwise(0)
    rows = rows.withColumns({"part": part, "ds": F.col("s") - F.col("s0"), "sd": F.stddev_samp("s").over(every), "mean": F.avg("s").over(every)})
    rows = rows.withColumn("z", (F.col("s") - F.col("mean")) / F.nullif("sd", F.lit(0.0)))
    rows = rows.withColumns({"z0": F.lag("z").over(w), "same": F.lag("part").over(w) == F.col("part")})
    if johansen:
        rows = unitroot.johansen_series(rows, w, "ly", "lx")
    entered = (F.abs("z") > entry) & (F.abs("z0") <= entry)
    crossed = F.col("z0").isNotNull() & ((F.col("z") < 0) != (F.col("z0") < 0))
    out = rows.groupBy(*KEY, "grp").agg(
        F.first("n").alias("n"), F.first("beta").alias("hedge_ratio"), F.first("sd").alias("sd"), F.corr("dy", "dx").alias("ret_corr"), series_of("t", "s").alias("_s"),
        F.regr_slope("ds", "s0").alias("k"), F.count_if(entered).alias("entries"), F.count_if(crossed).alias("crossings"), F.max_by("py", "t").alias("py"), F.max_by("px", "t").alias("px"),
        *[F.regr_slope(F.when((F.col("part") == c) & F.col("same"), F.col("ds")), F.when((F.col("part") == c) & F.col("same"), F.col("s0"))).alias(f"k{c}") for c in range(parts)],
        *[F.regr_slope(F.when(F.col("part") == c, F.col("ly")), F.when(F.col("part") == c, F.col("lx"))).alias(f"b{c}") for c in range(parts)],
        *(unitroot.johansen_moments() if johansen else []),
    )
    out = out.filter((F.col("sd") > 0) & F.col("ret_corr").isNotNull() & ~F.isnan("ret_corr") & (F.col("ret_corr") >= min_corr))
    out = unitroot.dickey_fuller(out, "_s", "eg_tstat", rule=autolag)
    if johansen:
        out = unitroot.johansen(out)
    if kpss:
        out = unitroot.kpss(out, "_s", "kpss").withColumnRenamed("kpss_p", "kpss_pvalue")
    out = out.drop("_s")
    b = F.abs("hedge_ratio")
    life = half_life_of(F.col("k"))
    lives = [half_life_of(F.col(f"k{c}")) for c in range(parts)]
    good = sum((F.when(v.between(min_half_life, max_half_life), 1.0).otherwise(0.0) for v in lives), F.lit(0.0)) / parts
    mean_b = sum((F.col(f"b{c}") for c in range(1, parts)), F.col("b0")) / parts
    var_b = sum(((F.col(f"b{c}") - mean_b) ** 2 for c in range(1, parts)), (F.col("b0") - mean_b) ** 2) / parts
    out = out.withColumns({
        "eg_pvalue": eg_p(F.col("eg_tstat")), "half_life": life, "entries_per_year": F.col("entries") * DAYS / F.col("n"), "crossings_per_year": F.col("crossings") * DAYS / F.col("n"),
        "gross_bps": 1e4 * (entry - leave) * F.col("sd") / (1 + b),
        "cost_bps": 2 * half_spread_bps + sell_fee_bps + 2e4 * comm_share * (1 / (1 + b) / F.col("py") + b / (1 + b) / F.col("px")) + borrow_bps * life / DAYS,
        "stability": good, "beta_cv": F.sqrt(var_b) / F.nullif(b, F.lit(0.0)),
    })
    out = out.withColumns({
        "net_bps": F.col("gross_bps") - F.col("cost_bps"), "edge_ratio": F.when(F.col("cost_bps") > 0, F.col("gross_bps") / F.col("cost_bps")),
        "net_edge_bps_per_year": F.col("entries_per_year") * (F.col("gross_bps") - F.col("cost_bps")),
    })
    out = corrected(out, ["screen"], "eg_pvalue", ["y", "x"], null_is_one=True)
    names = "n hedge_ratio ret_corr eg_tstat eg_pvalue half_life entries_per_year crossings_per_year gross_bps cost_bps net_bps edge_ratio net_edge_bps_per_year stability beta_cv".split()
    names += ["johansen_ok", "johansen_trace_ratio"] if johansen else []
    return out.select(*KEY, "grp", *names, *(["kpss_pvalue"] if kpss else []), F.col("p_bh").alias("eg_pvalue_fdr"))


def persistence(rows: DataFrame, tested: DataFrame, window: int, step: int, alpha: float = 0.05, screen_p: float = 0.10) -> DataFrame:
    """(y, x, n_windows, share_cointegrated, mean_p) over rolling windows, for pairs whose p in tested (y, x, p) is at most screen_p.

    A failed test counts as not cointegrated; pairs with fewer than window + step rows have no result.
    """
    w = Window.partitionBy("y", "x").orderBy("t")
    kept = rows.join(tested.filter(F.col("p") <= screen_p).select("y", "x"), ["y", "x"], "left_semi")
    kept = kept.withColumns({"i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("y", "x"))}).filter(F.col("n") >= window + step)
    first = F.greatest(F.ceil((F.col("i") - window + 1) / step), F.lit(0))
    last = F.least(F.floor(F.col("i") / step), F.floor((F.col("n") - window) / step))
    kept = kept.filter(first <= last).withColumn("screen", F.explode(F.sequence(first, last)))
    p = unitroot.dickey_fuller(residuals(kept, KEY).groupBy(*KEY).agg(series_of("t", "s").alias("_s")), "_s", "tau").withColumn("p", eg_p(F.col("tau")))
    return p.groupBy("y", "x").agg(F.count("p").alias("n_windows"), F.avg(F.when(F.col("p") < alpha, 1.0).otherwise(0.0)).alias("share_cointegrated"), F.avg("p").alias("mean_p"))


def candidates(train: DataFrame, by: list[str], selection: str = "fdr_bh", significance: float = 0.05, top_n: int = 20, least: int = 252, min_half_life: float = 1.0,
               max_half_life: float = 60.0, max_cost_to_move: float = 0.5, entry: float = 2.0, leave: float = 0.5, cost_bps: float = 5.0, slippage_bps: float = 1.0,
               stability_windows: int = 0, min_stability: float = 0.0, autolag: str | None = "aic") -> DataFrame:
    """Train-only candidates of each group of by, in two stages, on raw prices.

    Stage one tests every pair of the universe and corrects for all tests; stage two computes half-life, costs, the
    unit-root test of the spread and the share of stability_windows windows that pass for the preliminary set alone
    (at most top_n pairs a group), and filters it by half-life, cost and, with windows, stability.
    """
    key = [*by, "y", "x"]
    w = Window.partitionBy(*key).orderBy("t")
    rows = residuals(spread(train, key), key, "py", "px").withColumn("s0", F.lag("s").over(w)).withColumn("ds", F.col("s") - F.col("s0"))
    tested = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_obs"), series_of("t", "s").alias("_s"), F.regr_slope("ds", "s0").alias("slope"), F.first("beta").alias("beta"), F.first("alpha").alias("alpha"), F.stddev_samp("s").alias("sd"),
        F.stddev_samp("ds").alias("sd_change"), F.avg("py").alias("mean_y"), F.avg("px").alias("mean_x"),
    ).filter(F.col("n_obs") >= least)
    tested = unitroot.dickey_fuller(tested, "_s", "tau", rule=autolag).withColumn("p", eg_p(F.col("tau")))
    tested = corrected(tested, by, "p", ["y", "x"]).filter("p IS NOT NULL")  # a filter before would compute the test twice
    column = {"raw": "p", "fdr_bh": "p_bh", "bonferroni": "p_bonferroni"}[selection]
    kept = tested if selection == "raw" else tested.filter(F.col(column) <= significance)
    order = [F.round(column, 12), F.round("p", 12)]
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order, "y", "x"))
    kept = kept.withColumn("_first", first).filter(F.col("_first") <= top_n)
    life = F.when(F.col("slope") < 0, -F.log(F.lit(2.0)) / F.col("slope"))
    notional = F.col("mean_y") + F.abs("beta") * F.col("mean_x")
    kept = kept.withColumns({"half_life": life, "cost_to_move": 2 * (cost_bps + slippage_bps) / 1e4 * notional / (max(entry - leave, 0.1) * F.nullif("sd", F.lit(0.0)))})
    kept = kept.filter(F.col("half_life").between(min_half_life, max_half_life) & (F.col("cost_to_move") <= max_cost_to_move))
    kept = unitroot.dickey_fuller(spread(kept, key), "_s", "adf_tau", constant=True).withColumn("spread_adf_p", unitroot.adf_p(F.col("adf_tau"))).drop("_s")
    if stability_windows > 0:
        tried = train.join(kept.select(*key), key, "left_semi")
        rates = pass_rates(tried, key, stability_windows, significance, max(50, least // 2), "py", "px").select(*key, F.col("pass_rate").alias("stability"))
        kept = kept.join(rates, key, "left").filter(F.col("stability") >= min_stability)
    else:
        kept = kept.withColumn("stability", F.lit(None).cast("double"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order, *([] if selection == "raw" else [F.round("half_life", 9)]), "y", "x"))
    names = ["n_obs", "tau", "p", "p_bonferroni", "p_bh", "alpha", "beta", "sd", "sd_change", "half_life", "cost_to_move", "spread_adf_p", "stability", "place"]
    return kept.withColumn("place", place).select(*key, *names)


def diagnostics(rows: DataFrame, by: list[str], significance: float = 0.05, stability_windows: int = 4) -> DataFrame:
    """What a group's rows say of a pair that is given, on raw prices: p, hedge, half-life, stability, spread's sd and unit-root p, rows.

    A window of the stability has max(50, n div max(windows + 1, 2)) of the n rows.
    """
    key = [*by, "y", "x"]
    w = Window.partitionBy(*key).orderBy("t")
    s = residuals(rows, key, "py", "px").withColumn("s0", F.lag("s").over(w)).withColumn("ds", F.col("s") - F.col("s0"))
    out = s.groupBy(*key).agg(F.count("s").alias("train_obs"), series_of("t", "s").alias("_s"), F.regr_slope("ds", "s0").alias("slope"), F.first("beta").alias("train_beta"), F.stddev_samp("s").alias("train_spread_sd"))
    out = unitroot.dickey_fuller(unitroot.dickey_fuller(out, "_s", "tau"), "_s", "adf_tau", constant=True)
    out = out.withColumns({"train_coint_p": eg_p(F.col("tau")), "train_adf_p": unitroot.adf_p(F.col("adf_tau")), "train_half_life": F.when(F.col("slope") < 0, -F.log(F.lit(2.0)) / F.col("slope"))})
    least = F.greatest(F.lit(50), F.floor(F.col("_n") / max(stability_windows + 1, 2)))
    rates = pass_rates(rows, key, stability_windows, significance, least, "py", "px").select(*key, F.col("pass_rate").alias("train_stability"))
    return out.join(rates, key, "left").select(*key, "train_obs", "train_coint_p", "train_beta", "train_half_life", "train_stability", "train_spread_sd", "train_adf_p")


def explored(rows: DataFrame, significance: float = 0.05, least: int = 500, autolag: str | None = "aic") -> DataFrame:
    """Every pair's Engle-Granger p on raw prices at three significance levels, ordered by place (p, missing last)."""
    key = ["y", "x"]
    s = residuals(rows, key, "py", "px")
    tested = s.groupBy(*key).agg(F.count(F.lit(1)).alias("n_obs"), series_of("t", "s").alias("_s")).filter(F.col("n_obs") >= least)
    tested = unitroot.dickey_fuller(tested, "_s", "tau", rule=autolag).withColumn("p", eg_p(F.col("tau"))).drop("_s", "tau_lag")
    out = corrected(tested.withColumn("all", F.lit(1)), ["all"], "p", key).drop("all", "p_holm")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round("p", 12).asc_nulls_last(), *key))  # one row per pair
    return out.withColumns({"significant": F.col("p") < significance, "significant_bonferroni": F.col("p_bonferroni") <= significance, "significant_bh": F.col("p_bh") <= significance, "place": place})
