"""Evaluation over folds: pairs chosen on train rows, thresholds on validation rows, money counted on test rows.

The folds table has a few rows; it is joined to pair rows by position, and fold (and
segment) is a key of every step, so that all folds of all pairs are one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranking, simulate, tradability
from ..operators.intervals import within
from . import walkforward

PAIR = ["y", "x"]
KEY = ["fold", "y", "x"]


def train_rows(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of each fold's training part; a row serves every fold that trains on it."""
    return within(rows, folds.select("fold", "train_lo", "train_hi"), "train_lo", "train_hi")


def segments(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Validation and test rows: adds fold and segment ('val', 'test')."""
    parts = folds.select("fold", F.explode(F.array(F.struct(F.lit("val").alias("segment"), F.col("val_lo").alias("lo"), F.col("val_hi").alias("hi")), F.struct(F.lit("test").alias("segment"), F.col("test_lo").alias("lo"), F.col("test_hi").alias("hi")))).alias("s"))
    return within(rows, parts.select("fold", "s.*"))


def chosen_pairs(rows: DataFrame, folds: DataFrame, **parameters) -> DataFrame:
    """Train-only candidates of each fold (see tradability.candidates)."""
    return tradability.candidates(train_rows(rows.select(*PAIR, "t", "py", "px"), folds), ["fold"], **parameters)


def diagnosed(rows: DataFrame, folds: DataFrame, given: DataFrame, significance: float = 0.05, stability_windows: int = 4) -> DataFrame:
    """Train-only diagnostics of given pairs (y, x) in each fold (see tradability.diagnostics)."""
    kept = rows.select(*PAIR, "t", "py", "px").join(given.select(*PAIR).distinct(), PAIR, "left_semi")
    return tradability.diagnostics(train_rows(kept, folds), ["fold"], significance, stability_windows)


def simulated(z_rows: DataFrame, folds: DataFrame, pairs: DataFrame | None, cells: DataFrame, capital: float, units: float = 10.0, **costs) -> DataFrame:
    """Daily money of every (fold, segment, pair, entry, exit): positions restart in each segment."""
    by = ["fold", "segment", *PAIR, "entry", "exit"]
    rows = segments(z_rows, folds)
    if pairs is not None:
        rows = rows.join(pairs.select(*KEY), KEY, "left_semi")
    rows = simulate.grid_positions(rows.crossJoin(F.broadcast(cells)), ["fold", "segment", *PAIR])
    pnl = simulate.engine_pnl(rows.withColumn("units", F.lit(units)), by, **costs)
    return simulate.with_runs(pnl, by, "executed").withColumn("r", F.col("net") / capital)


def evaluated(money: DataFrame, least_val_trades: int = 2, least_test_trades: int = 2) -> DataFrame:
    """(fold, y, x, entry, exit, val_*, test_*): the cell that validation picks, and what it does on the test rows."""
    val = walkforward.tuned(money.filter("segment = 'val'"), least_val_trades, tuple(KEY))
    val = val.select(*KEY, "entry", "exit", F.col("sharpe").alias("val_sharpe"), F.col("n_trades").alias("val_trades"), F.col("cost_share").alias("val_cost_share"))
    test = held(money, val)
    w = Window.partitionBy(*KEY).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    test = test.withColumn("eq", 1 + F.sum("r").over(w))
    test = test.withColumn("dd", F.col("eq") / F.max("eq").over(w) - 1)
    sums = test.groupBy(*KEY).agg(
        sharpe(F.count("r"), F.sum("r"), F.sum(F.col("r") * F.col("r"))).alias("test_sharpe"), F.sum("r").alias("test_return"), F.greatest(F.min("dd"), F.lit(-1.0)).alias("test_drawdown"),
    )
    totals = walkforward.segment_totals(test, KEY).select(*KEY, F.col("n_trades").alias("test_trades"), F.col("cost_share").alias("test_cost_share"))
    out = val.join(sums, KEY).join(totals, KEY)
    return out.withColumn("sufficient", F.col("test_trades") >= least_test_trades)


def held(money: DataFrame, chosen: DataFrame) -> DataFrame:
    """The test rows of the cells that validation chose."""
    return money.filter("segment = 'test'").join(chosen.select(*KEY, "entry", "exit"), [*KEY, "entry", "exit"], "left_semi")


def sharpe(n, total, squares):
    """Yearly Sharpe from a count, a sum and a sum of squares: rows that are 0 need not exist."""
    some = F.nullif(n, F.lit(0))
    var = (squares - total * total / some) / F.nullif(n - 1, F.lit(0))
    return F.when((n >= 2) & (var > 1e-24), total / some / F.sqrt(var) * F.sqrt(F.lit(252.0)))


def growth_of(column: str):
    """log(1 + r); a day that loses all capital or more leaves next to nothing."""
    return F.log1p(F.greatest(F.col(column), F.lit(-1 + 1e-12)))


def fold_summary(results: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, selected_pairs, sufficient_trade_pairs, positive_test_sharpes, median_test_sharpe, mean_test_return), folds without pairs included."""
    good = F.col("sufficient")
    out = results.groupBy("fold").agg(
        F.count(F.lit(1)).alias("selected_pairs"), F.count_if(good).alias("sufficient_trade_pairs"), F.count_if(good & (F.col("test_sharpe") > 0)).alias("positive_test_sharpes"),
        F.percentile(F.when(good, F.col("test_sharpe")), 0.5).alias("median_test_sharpe"), F.avg(F.when(good, F.col("test_return"))).alias("mean_test_return"),
    )
    return folds.select("fold").join(out, "fold", "left").na.fill(0, ["selected_pairs", "sufficient_trade_pairs", "positive_test_sharpes"])


def stitched(test: DataFrame, folds: DataFrame, dates: DataFrame) -> DataFrame:
    """(y, x, walk_forward_*): the test blocks of all folds one after the other; a fold in which a pair is not traded earns 0.

    Days that earn 0 add to the count alone.  A day that two folds share is counted once, in the first fold.
    """
    w = Window.partitionBy(*PAIR).orderBy("t")
    one = test.withColumn("_place", F.row_number().over(Window.partitionBy(*PAIR, "t").orderBy("fold"))).filter("_place = 1")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    eq = one.withColumn("log", F.sum(growth_of("r")).over(upto)).withColumn("top", F.greatest(F.max("log").over(upto), F.lit(0.0)))
    days = folds.select(F.explode(F.sequence("test_lo", F.col("test_hi") - 1)).alias("t")).distinct().join(dates.select("t", "date").distinct(), "t")
    clock = days.agg(F.count(F.lit(1)).alias("days"), F.datediff(F.max("date"), F.min("date")).alias("span"), F.min("t").alias("t_first"))
    out = eq.groupBy(*PAIR).agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"), F.sum(F.when(F.col("r") < 0, F.col("r") * F.col("r"))).alias("dq"), F.count_if(F.col("r") < 0).alias("dn"), F.max_by("log", "t").alias("growth"), F.min(F.expm1(F.col("log") - F.col("top"))).alias("dd"), F.min_by("log", "t").alias("g0"), F.min("t").alias("t0"))
    out = out.crossJoin(F.broadcast(clock))  # one row
    # the first value of the equity curve: after the first test day
    first = F.when(F.col("t0") == F.col("t_first"), F.col("g0")).otherwise(0.0)
    return out.select(
        *PAIR, sharpe(F.col("days"), F.col("s"), F.col("q")).alias("walk_forward_sharpe"),
        F.when(F.col("dn") > 0, F.col("s") / F.col("days") / F.sqrt(F.col("dq") / F.col("dn")) * F.sqrt(F.lit(252.0))).when(F.col("s") > 0, F.lit(float("inf"))).alias("walk_forward_sortino"),
        F.expm1("growth").alias("walk_forward_return"), F.when(F.col("span") > 0, F.expm1((F.col("growth") - first) * 365.25 / F.col("span"))).alias("walk_forward_cagr"),
        F.greatest("dd", F.lit(-1.0)).alias("walk_forward_max_drawdown"),
    )


def pair_summary(results: DataFrame, n_folds: int) -> DataFrame:
    """Per pair: folds selected, valid and sufficient, Sharpe and return statistics of the folds, costs, trades."""
    valid, good, up = F.col("test_sharpe").isNotNull(), F.col("sufficient") & F.col("test_sharpe").isNotNull(), F.col("test_sharpe") > 0

    def over(condition, agg, column):
        return agg(F.when(condition, F.col(column)))

    out = results.groupBy(*PAIR).agg(
        F.lit(n_folds).alias("available_folds"), F.count(F.lit(1)).alias("selected_folds"), F.count_if(valid).alias("valid_test_folds"), F.count_if(valid & up).alias("positive_folds"),
        F.count_if(good).alias("sufficient_trade_folds"), F.count_if(good & up).alias("positive_sufficient_folds"), over(valid, F.avg, "test_sharpe").alias("mean_test_sharpe"),
        F.percentile(F.when(valid, F.col("test_sharpe")), 0.5).alias("median_test_sharpe"), over(valid, F.min, "test_sharpe").alias("worst_test_sharpe"), over(valid, F.avg, "test_return").alias("mean_test_return"),
        over(valid, F.min, "test_drawdown").alias("worst_test_drawdown"), over(valid, F.avg, "test_cost_share").alias("mean_cost_pct"), F.percentile(F.when(valid, F.col("test_cost_share")), 0.5).alias("median_cost_pct"),
        over(valid, F.avg, "test_trades").alias("mean_completed_trades"), F.percentile(F.when(valid, F.col("test_trades")), 0.5).alias("median_completed_trades"),
        F.coalesce(over(valid, F.sum, "test_trades"), F.lit(0)).alias("total_completed_trades"),
    )
    return out.withColumns({
        "selected_fraction": F.col("selected_folds") / F.col("available_folds"), "positive_fold_fraction": F.col("positive_folds") / F.nullif("valid_test_folds", F.lit(0)),
        "positive_sufficient_fold_fraction": F.col("positive_sufficient_folds") / F.nullif("sufficient_trade_folds", F.lit(0)),
    })


def quality(sharpe_column: str, trades_column: str, target: int = 5):
    """Validation Sharpe times the square root of trades over the target (at most 1); null without trades."""
    share = F.least(F.lit(1.0), F.col(trades_column) / target)
    return F.when(F.col(trades_column) > 0, F.col(sharpe_column) * F.sqrt(share))


def watchlist(results: DataFrame, k: int = 6, least_sharpe: float = 0.5, least_trades: int = 3, most_cost_share: float = 0.3, target: int = 5, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """The k best pairs of each fold by validation quality, of those that pass the validation filters: adds val_quality and place."""
    d = results.withColumn("val_quality", F.round(quality("val_sharpe", "val_trades", target), 9))
    d = d.filter((F.col("val_sharpe") >= least_sharpe) & (F.col("val_trades") >= least_trades) & (F.col("val_cost_share").isNull() | (F.col("val_cost_share") <= most_cost_share)) & (F.col("val_quality") > 0))
    return ranking.top_k(d, list(by), [F.col("val_quality").desc(), *PAIR], k)


def allocation(members: DataFrame, mode: str, by: list[str], cap: float) -> DataFrame:
    """Adds weight by mode (equal, inverse_vol, validation_sharpe, validation_quality, hybrid), capped; what caps cut goes to the others, a rest stays cash."""
    inverse = F.when(F.col("sd_change") > 1e-12, 1 / F.col("sd_change")).otherwise(0.0)
    positive = {c: F.greatest(F.col(c), F.lit(0.0)) for c in ("val_sharpe", "val_quality")}
    base = {"equal": F.lit(1.0), "inverse_vol": inverse, "validation_sharpe": positive["val_sharpe"], "validation_quality": positive["val_quality"], "hybrid": positive["val_quality"] * inverse}[mode]
    return capped(members.withColumn("base", base), by, "base", cap)


def capped(rows: DataFrame, by: list[str], base: str, cap: float, total: float = 1.0) -> DataFrame:
    """Adds weight: shares of total in proportion to base, none above cap.

    Whoever is above the cap at the common rate is capped; in order of falling base these come first, so their number follows
    from running sums.  What capped members leave goes to the others; if those have no base, in equal parts.  All base 0: equal.
    """
    w = Window.partitionBy(*by)
    rows = rows.withColumn("_p", F.greatest(F.coalesce(F.col(base).cast("double"), F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("_p", F.when(F.sum("_p").over(w) > 0, F.col("_p")).otherwise(1.0))
    down = w.orderBy(F.col("_p").desc())
    rows = rows.withColumn("_k", F.row_number().over(down)).withColumn("_n", F.count(F.lit(1)).over(w))
    before = F.coalesce(F.sum("_p").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_p").over(w) - before
    rows = rows.withColumns({"_left": F.greatest(F.lit(float(total)) - (F.col("_k") - 1) * cap, F.lit(0.0)), "_rest": rest})
    # at the rate of those from this place on, is this place above the cap?
    rows = rows.withColumn("_over", (F.col("_p") > 0) & (F.col("_left") * F.col("_p") >= (cap - 1e-15) * F.col("_rest")))
    first = F.min(F.when(~F.col("_over"), F.struct("_k", "_left", "_rest", (F.col("_p") > 0).alias("some")))).over(w)
    rows = rows.withColumn("_f", first)
    shared = F.when(F.col("_f.some"), F.col("_f._left") * F.col("_p") / F.col("_f._rest")).otherwise(F.least(F.lit(float(cap)), F.col("_f._left") / (F.col("_n") - F.col("_f._k") + 1)))
    full = F.least(F.lit(float(cap)), F.col("_left"))
    weight = F.when(F.col("_f").isNull() | (F.col("_k") < F.col("_f._k")), full).otherwise(shared)
    return rows.withColumn("weight", weight).drop("_p", "_k", "_n", "_left", "_rest", "_over", "_f")


def portfolio_daily(test: DataFrame, weights: DataFrame, folds: DataFrame, reallocate: bool = False, active_cap: float = 0.5, active_total: float = 1.0, cells: DataFrame | None = None) -> DataFrame:
    """(fold, t, r, active_weight, active_pairs): every test day of every fold; reallocate: weights of the day's active pairs grow up to active_cap.

    cells: a small table of parameter cells; its columns are keys of weights and of the result.  weights.scale, where it exists, multiplies r.
    """
    more = cells.columns if cells is not None else []
    by = [*more, "fold", "t"]
    scaled = "scale" in weights.columns
    rows = test.join(weights.select(*more, *KEY, "weight", *(["scale"] if scaled else [])), KEY).withColumn("active", F.when(F.col("executed") != 0, 1.0).otherwise(0.0))
    if scaled:
        rows = rows.withColumn("r", F.col("r") * F.col("scale"))
    if reallocate:
        rows = capped(rows.withColumn("base", F.col("weight") * F.col("active")).drop("weight"), by, "base", active_cap)
        total = F.sum("weight").over(Window.partitionBy(*by))
        rows = rows.withColumn("weight", F.when(total > active_total, F.col("weight") * active_total / total).otherwise(F.col("weight")))
        active = F.col("weight")
    else:
        active = F.col("weight") * F.col("active")
    sums = rows.withColumn("w", active).groupBy(*by).agg(F.sum(F.col("r") * F.col("weight")).alias("r"), F.sum("w").alias("active_weight"), F.count_if(F.col("w") > 0).alias("active_pairs"))
    days = folds.select("fold", F.explode(F.sequence("test_lo", F.col("test_hi") - 1)).alias("t"))
    if cells is not None:
        days = days.crossJoin(F.broadcast(cells))  # some cells of parameters
    return days.join(sums, by, "left").na.fill(0.0, ["r", "active_weight"]).na.fill(0, ["active_pairs"])


def sized(rows: DataFrame, folds: DataFrame, chosen: DataFrame, risks: list[float], capital: float, leverage: float = 2.0) -> DataFrame:
    """(fold, y, x, risk_target, units): spread units whose yearly risk is risk_target of capital, from train rows alone.

    chosen has beta and sd_change of the train rows; the notional is that of the last train row, and leverage bounds it.  Without
    variation of the spread one unit is held; a bound of nothing gives one unit too.
    """
    last = rows.select(*PAIR, "t", "py", "px").join(F.broadcast(folds.select("fold", (F.col("train_hi") - 1).alias("t"))), "t")  # a row for each fold
    d = chosen.select(*KEY, "beta", "sd_change").join(last.select(*KEY, "py", "px"), KEY).withColumn("risk_target", F.explode(F.array(*[F.lit(float(r)) for r in risks])))
    most = capital * leverage / F.greatest(F.col("py") + F.abs("beta") * F.col("px"), F.lit(1e-12))
    wanted = F.when(F.col("sd_change") > 1e-12, capital * F.col("risk_target") / (F.col("sd_change") * F.sqrt(F.lit(252.0)))).otherwise(1.0)
    units = F.greatest(F.least(wanted, most), F.lit(0.0))
    return d.select(*KEY, "risk_target", F.when(units > 1e-12, units).when(most > 1e-12, most).otherwise(1.0).alias("units"))


def swept(results: DataFrame, test: DataFrame, chosen: DataFrame, sizes: DataFrame, folds: DataFrame, ks: list[int], mode: str = "validation_quality", cap: float = 0.25, units: float = 10.0, filters: tuple = (0.0, 3, 0.3, 5),
          reallocate: bool = True, active_cap: float = 0.5, active_total: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Portfolios of every cell (risk_target, top_k) at once: (daily, members).

    Money is linear in the spread units, and what validation picks does not depend on them: one simulation with `units` serves all
    risk targets, each as a factor of its rows.  filters: least validation Sharpe and trades, most cost share, trades that count in full.
    """
    best = watchlist(results, max(ks), *filters).join(chosen.select(*KEY, "sd_change"), KEY)
    best = best.withColumn("top_k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("place <= top_k")
    weights = allocation(best, mode, ["fold", "top_k"], cap).select(*KEY, "top_k", "weight", "test_trades")
    members = weights.join(sizes, KEY).withColumn("scale", F.col("units") / units)
    cells = sizes.select("risk_target").distinct().withColumn("top_k", F.explode(F.array(*[F.lit(k) for k in ks])))
    daily = portfolio_daily(test, members, folds, reallocate, active_cap, active_total, cells)
    base = members.groupBy("risk_target", "top_k", "fold").agg(F.sum("weight").alias("base_weight"))
    return daily.join(base, ["risk_target", "top_k", "fold"], "left").na.fill(0.0, ["base_weight"]), members


def portfolio_report(daily: DataFrame, members: DataFrame, folds: DataFrame, dates: DataFrame, by: list[str], complete: bool = True) -> DataFrame:
    """A row per cell: span and coverage of the test days, return and risk measures, weights, share of good folds, trades.

    complete: the test days of all folds must be there once each, from the first test row to the last; a gap fails the job.
    A day of two folds counts in the first.  Only days that `dates` (t, date) has exist.
    """
    kept = F.struct("fold", "r", "active_weight", "active_pairs", "base_weight")
    one = daily.groupBy(*by, "t").agg(F.min_by(kept, "fold").alias("_d")).select(*by, "t", "_d.*").join(dates.select("t", "date").distinct(), "t")
    w = Window.partitionBy(*by).orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("log", F.sum(growth_of("r")).over(upto)).withColumn("top", F.max("log").over(upto)).withColumn("pos", F.row_number().over(w))
    one = one.withColumn("under", F.exp("log") < F.exp("top") - 1e-12)
    one = one.withColumn("streak", F.when(F.col("under"), F.col("pos") - F.coalesce(F.max(F.when(~F.col("under"), F.col("pos"))).over(upto), F.lit(0))).otherwise(0))
    n, r = F.count(F.lit(1)), F.col("r")
    out = one.groupBy(*by).agg(
        F.min("date").alias("oos_start"), F.max("date").alias("oos_end"), n.alias("oos_rows"), sharpe(n, F.sum(r), F.sum(r * r)).alias("sharpe"), F.avg(r).alias("_m"),
        F.avg(F.when(r < 0, r * r)).alias("_down"), F.max_by("log", "t").alias("_g"), F.greatest(F.min(F.expm1(F.col("log") - F.col("top"))), F.lit(-1.0)).alias("max_drawdown"),
        F.max("streak").cast("long").alias("max_drawdown_days"), (F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("annualized_vol"), F.avg("base_weight").alias("avg_allocated_weight"),
        F.avg("active_weight").alias("avg_active_weight"), F.avg("active_pairs").alias("avg_active_pairs"),
    )
    each = daily.groupBy(*by, "fold").agg(sharpe(n, F.sum(r), F.sum(r * r)).alias("s")).groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), F.avg(F.when(F.col("s") > 0, 1.0).otherwise(0.0)).alias("positive_fold_fraction"))
    trades = members.groupBy(*by).agg(F.sum("test_trades").alias("completed_trades"))
    span = folds.agg((F.max("test_hi") - F.min("test_lo")).cast("long").alias("_span"))
    out = out.join(each, by).join(trades, by, "left").na.fill(0, ["completed_trades"]).crossJoin(F.broadcast(span))  # one row
    whole = F.col("oos_rows") == F.col("_span")
    if complete:
        whole = F.when(whole, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("test days are not covered: "), F.col("oos_rows").cast("string"), F.lit(" of "), F.col("_span").cast("string"))).cast("boolean"))
    days = F.datediff("oos_end", "oos_start")
    sortino = F.when(F.col("_down").isNull() & (F.col("_m") > 0), F.lit(float("inf"))).when(F.col("_down") > 1e-24, F.col("_m") / F.sqrt("_down") * F.sqrt(F.lit(252.0)))
    return out.select(
        *by, "folds", "oos_start", "oos_end", days.alias("oos_calendar_days"), "oos_rows", whole.alias("oos_complete"), "sharpe", sortino.alias("sortino"), F.expm1("_g").alias("total_return"),
        F.when(days > 0, F.expm1(F.col("_g") * 365.25 / days)).alias("cagr"), "max_drawdown", "max_drawdown_days", "annualized_vol", "avg_allocated_weight", "avg_active_weight", "avg_active_pairs",
        "positive_fold_fraction", "completed_trades",
    )


def portfolio_summary(daily: DataFrame, by: list[str]) -> DataFrame:
    """(by, days, sharpe, total_return, max_drawdown, avg_active_weight, avg_active_pairs) of daily returns, compounded."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = daily.withColumn("log", F.sum(growth_of("r")).over(w))
    rows = rows.withColumn("dd", F.expm1(F.col("log") - F.max("log").over(w)))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"), sharpe(F.count(F.lit(1)), F.sum("r"), F.sum(F.col("r") * F.col("r"))).alias("sharpe"), F.expm1(F.max_by("log", "t")).alias("total_return"),
        F.greatest(F.min("dd"), F.lit(-1.0)).alias("max_drawdown"), F.avg("active_weight").alias("avg_active_weight"), F.avg("active_pairs").alias("avg_active_pairs"),
    )


def covered(daily: DataFrame, folds: DataFrame) -> bool:
    """Whether continuous folds' test days are all there once: from the first test row to the last."""
    have = daily.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("d")).first()
    span = folds.agg((F.max("test_hi") - F.min("test_lo")).alias("n")).first()["n"]
    return have["n"] == have["d"] == (span or 0)
