"""Regression and window features of pair panels (rows by y, x in order of t).

All windows partition by pair, so one exchange on (y, x) serves a whole chain of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("y", "x")


def by_pair():
    return Window.partitionBy(*KEY).orderBy("t")


def returns(rows: DataFrame) -> DataFrame:
    """Log returns ry, rx and price changes dy, dx."""
    w = by_pair()
    return (
        rows.withColumn("ry", F.col("ly") - F.lag("ly").over(w)).withColumn("rx", F.col("lx") - F.lag("lx").over(w))
        .withColumn("dy", F.col("py") - F.lag("py").over(w)).withColumn("dx", F.col("px") - F.lag("px").over(w))
    )


def static_hedge(rows: DataFrame, y: str = "ly", x: str = "lx") -> DataFrame:
    """(y, x, alpha, beta, n) by least squares over all rows of a pair."""
    return rows.groupBy(*KEY).agg(F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("alpha"), F.count(F.lit(1)).alias("n"))


def static_spread(rows: DataFrame, y: str = "ly", x: str = "lx") -> DataFrame:
    """alpha, beta and spread by least squares over all rows of a pair, as windows over the pair: no join back."""
    w = Window.partitionBy(*KEY)
    out = rows.withColumn("beta", F.covar_pop(y, x).over(w) / F.nullif(F.var_pop(x).over(w), F.lit(0.0)))
    out = out.withColumn("alpha", F.avg(y).over(w) - F.col("beta") * F.avg(x).over(w))
    return out.withColumn("spread", F.col(y) - F.col("beta") * F.col(x) - F.col("alpha"))


def half_life_ar1(spread: DataFrame) -> DataFrame:
    """-ln 2 / ln phi, phi = 1 + slope of the change on the level; null unless 0 < phi < 1."""
    rows = spread.withColumn("s0", F.lag("spread").over(by_pair())).withColumn("ds", F.col("spread") - F.col("s0"))
    out = rows.groupBy(*KEY).agg((1 + F.regr_slope("ds", "s0")).alias("phi"))
    return out.select(*KEY, F.when((F.col("phi") > 0) & (F.col("phi") < 1), -F.log(F.lit(2.0)) / F.log("phi")).alias("half_life"))


def half_life_slope(spread: DataFrame, least: int = 30) -> DataFrame:
    """-ln 2 / slope; infinite if the slope is not negative; null under 30 observations."""
    rows = spread.withColumn("s0", F.lag("spread").over(by_pair())).withColumn("ds", F.col("spread") - F.col("s0"))
    out = rows.groupBy(*KEY).agg(F.regr_slope("ds", "s0").alias("b"), F.count("spread").alias("n"))
    return out.select(*KEY, F.when(F.col("n") >= least, F.when(F.col("b") >= 0, F.lit(float("inf"))).otherwise(-F.log(F.lit(2.0)) / F.col("b"))).alias("half_life"))


def hurst(spread: DataFrame, most: int = 50) -> DataFrame:
    """Slope of log std(s[t+lag] - s[t]) on log lag, lags from 2 to below max(3, min(most, n div 4)), n the pair's rows."""
    w = by_pair()
    rows = spread.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*KEY)))
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), (F.lead("spread", k).over(w) - F.col("spread")).alias("d")) for k in range(2, most)])
    long = rows.select(*KEY, "_n", lags.alias("l")).select(*KEY, "_n", F.explode("l").alias("l")).select(*KEY, "_n", "l.lag", "l.d")
    long = long.filter(F.col("lag") < F.greatest(F.lit(3), F.least(F.lit(most), F.floor(F.col("_n") / 4))))
    tau = long.groupBy(*KEY, "lag").agg(F.stddev_pop("d").alias("tau")).filter("tau > 0")
    return tau.groupBy(*KEY).agg(F.regr_slope(F.log("tau"), F.log(F.col("lag").cast("double"))).alias("hurst"))


def window_sums(rows: DataFrame, window: int, lagged: bool, sums: dict, by: tuple[str, ...] = KEY) -> DataFrame:
    """Adds, per name, the sum of its expression over window rows (up to today, or strictly before it).

    Running sums and their lagged differences: the cost of a row does not grow with the window.
    """
    w = Window.partitionBy(*by).orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_run_{k}": F.sum(F.coalesce(v, F.lit(0.0))).over(upto) for k, v in sums.items()})
    shift = 1 if lagged else 0

    def part(k):
        end = F.coalesce(F.lag(f"_run_{k}", 1).over(w), F.lit(0.0)) if lagged else F.col(f"_run_{k}")
        return end - F.coalesce(F.lag(f"_run_{k}", window + shift).over(w), F.lit(0.0))

    return rows.withColumns({k: part(k) for k in sums}).drop(*[f"_run_{k}" for k in sums])


def rolling_ols(rows: DataFrame, window: int, lagged: bool, y: str = "py", x: str = "px") -> DataFrame:
    """beta, alpha, resid_sd over window rows: up to today, or strictly before it; null until a window is full.

    The sums are of values less the pair's mean, which keeps their differences exact enough.
    """
    every = Window.partitionBy(*KEY)
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    rows = rows.withColumns({"_my": F.avg(y).over(every), "_mx": F.avg(x).over(every)})
    a, b = F.when(both, F.col(y) - F.col("_my")), F.when(both, F.col(x) - F.col("_mx"))
    rows = window_sums(rows, window, lagged, {"_n": F.when(both, 1.0), "_y": a, "_x": b, "_yy": a * a, "_xx": b * b, "_xy": a * b})
    n = F.when(F.col("_n") > 1, F.col("_n"))

    def moment(s, u, v):
        return (F.col(s) - F.col(u) * F.col(v) / n) / (n - 1)

    full = n == window
    rows = rows.withColumns({"_vx": F.when(full, moment("_xx", "_x", "_x")), "_c": F.when(full, moment("_xy", "_x", "_y")), "_vy": F.when(full, moment("_yy", "_y", "_y"))})
    rows = rows.withColumn("beta", F.when(F.col("_vx") > 1e-14, F.col("_c") / F.col("_vx")))
    rows = rows.withColumn("alpha", F.col("_my") + F.col("_y") / n - F.col("beta") * (F.col("_mx") + F.col("_x") / n))
    rows = rows.withColumn("resid_sd", F.sqrt(F.greatest(F.col("_vy") - F.col("beta") * F.col("_c"), F.when(F.col("beta").isNotNull(), 0.0))))
    return rows.drop("_my", "_mx", "_n", "_y", "_x", "_yy", "_xx", "_xy", "_vx", "_c", "_vy")


def lagged_z(rows: DataFrame, window: int, column: str = "spread", least: int | None = None) -> DataFrame:
    """z of today's value against the window values before it."""
    least = max(20, window // 2) if least is None else least
    rows = rows.withColumn("_m", F.avg(column).over(Window.partitionBy(*KEY)))
    c = F.col(column) - F.col("_m")
    rows = window_sums(rows, window, True, {"_n": F.when(c.isNotNull(), 1.0), "_s": c, "_q": c * c})
    n, s = F.when(F.col("_n") > 1, F.col("_n")), F.col("_s")
    rows = rows.withColumn("_v", F.when(n >= least, (F.col("_q") - s * s / n) / (n - 1)))
    return rows.withColumn("z", F.when(F.col("_v") > 1e-18, (c - s / n) / F.sqrt("_v"))).drop("_m", "_n", "_s", "_q", "_v")


def frozen_z(rows: DataFrame, window: int, y: str = "ly", x: str = "lx") -> DataFrame:
    """z of today's spread against exactly the window spreads before it, all at today's beta (column beta).

    Spreads at another beta need no second pass: mean and variance follow from the windowed sums of y, x, yy, xx and xy.
    """
    every = Window.partitionBy(*KEY)
    rows = rows.withColumns({"_my": F.avg(y).over(every), "_mx": F.avg(x).over(every)})
    a, b = F.col(y) - F.col("_my"), F.col(x) - F.col("_mx")
    rows = window_sums(rows, window, True, {"_n": F.when((a * b).isNotNull(), 1.0), "_y": a, "_x": b, "_yy": a * a, "_xx": b * b, "_xy": a * b})
    k, n = F.col("beta"), F.when(F.col("_n") > 1, F.col("_n"))
    mean = (F.col("_y") - k * F.col("_x")) / n
    square = F.col("_yy") - 2 * k * F.col("_xy") + k * k * F.col("_xx")
    sd = F.sqrt(F.greatest((square - n * mean * mean) / (n - 1), F.lit(0.0)))
    rows = rows.withColumn("_sd", F.when(n == window, sd)).withColumn("z", F.when(F.col("_sd") >= 1e-12, (a - k * b - mean) / F.col("_sd")))
    return rows.drop("_my", "_mx", "_n", "_y", "_x", "_yy", "_xx", "_xy", "_sd")


def hedge(rows: DataFrame, mode: str, window: int = 120, lagged: bool = False) -> DataFrame:
    """beta and alpha per row on raw prices by mode: static (constant), rolling, or kalman."""
    if mode == "static":
        return static_spread(rows, "py", "px").drop("spread")
    if mode == "rolling":
        return rolling_ols(rows, window, lagged).drop("resid_sd")
    if mode == "kalman":
        from .screens import kalman_hedge

        return kalman_hedge(rows, list(KEY))
    raise ValueError(f"unknown hedge mode {mode!r}")


def display_z(rows: DataFrame, window: int = 60, column: str = "spread") -> DataFrame:
    """Rolling mean, deviation and z that include today, as charts show them."""
    w = by_pair().rowsBetween(1 - window, 0)
    full = F.count(column).over(w) == window
    out = rows.withColumn("mean", F.when(full, F.avg(column).over(w))).withColumn("sd", F.when(full, F.stddev_samp(column).over(w)))
    return out.withColumn("z", (F.col(column) - F.col("mean")) / F.nullif("sd", F.lit(0.0)))


def block_fits(rows: DataFrame, start: int, step: int, lookback: int) -> DataFrame:
    """(y, x, block, alpha, beta, mu, sd): each block of step rows is fitted on the lookback rows before it.

    A row serves lookback / step fits: it is replicated to those blocks and summed there, which is one exchange.
    """
    first = F.floor((F.col("t") - F.lit(start)) / F.lit(step)) + 1
    last = F.floor((F.col("t") - F.lit(start) + lookback) / F.lit(step))
    rows = rows.select(*KEY, "ly", "lx", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.greatest(last, F.lit(0)))).alias("block"), "t")
    rows = rows.filter((F.col("t") < start + F.col("block") * step) & (F.col("t") >= start + F.col("block") * step - lookback))
    out = rows.groupBy(*KEY, "block").agg(
        F.regr_slope("ly", "lx").alias("beta"), F.regr_intercept("ly", "lx").alias("alpha"), F.count(F.lit(1)).alias("n"),
        F.var_samp("ly").alias("vy"), F.covar_samp("ly", "lx").alias("cxy"),
    )
    sd = F.sqrt(F.greatest(F.col("vy") - F.col("beta") * F.col("cxy"), F.lit(0.0)))
    return out.filter("n > 2").select(*KEY, "block", "alpha", "beta", F.lit(0.0).alias("mu"), sd.alias("sd"))


def block_z(rows: DataFrame, start: int, step: int, lookback: int) -> DataFrame:
    """(.., block, alpha, beta, z, ds): z by the block's fit, ds: the day's spread change at the live beta."""
    fits = block_fits(rows, start, step, lookback)
    live = rows.withColumn("dly", F.col("ly") - F.lag("ly").over(by_pair())).withColumn("dlx", F.col("lx") - F.lag("lx").over(by_pair()))
    live = live.filter(F.col("t") >= start).withColumn("block", F.floor((F.col("t") - F.lit(start)) / F.lit(step)))
    out = live.join(fits, [*KEY, "block"])
    z = (F.col("ly") - F.col("alpha") - F.col("beta") * F.col("lx") - F.col("mu")) / F.nullif("sd", F.lit(0.0))
    return out.withColumn("z", z).withColumn("ds", F.col("dly") - F.col("beta") * F.col("dlx"))


def crossings(rows: DataFrame, entry: float = 2.0, column: str = "z") -> DataFrame:
    """(y, x, n, sign changes, entries above the threshold); 0 counts as positive."""
    w = by_pair()
    rows = rows.filter(F.col(column).isNotNull())
    rows = rows.withColumn("neg", F.col(column) < 0).withColumn("out", F.abs(column) > entry)
    rows = rows.withColumn("neg0", F.lag("neg").over(w)).withColumn("out0", F.lag("out").over(w))
    return rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("neg") != F.col("neg0")).alias("n_cross"), F.count_if(F.col("out") & ~F.col("out0")).alias("n_entry")
    )
