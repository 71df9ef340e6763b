"""Panel studies: regressions without intercept, clustered errors, gates, permutation baselines, bootstrap, exit tables."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.native import normal_two_sided, t_two_sided
from .ranking import PRIME, keyed_places, numbered, random_subsets


def complete(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows that have all of the columns: to be taken before any of them is demeaned or summed."""
    for c in columns:
        rows = rows.filter(F.col(c).isNotNull())
    return rows


def demeaned(rows: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """columns less their group means, over the rows that have all of them."""
    w = Window.partitionBy(*by)
    rows = complete(rows, *columns)
    for c in columns:
        rows = rows.withColumn(c, F.col(c) - F.avg(c).over(w))
    return rows


def slope(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """coef = sum xy / sum xx (no intercept), over the rows that have both."""
    out = complete(rows, x, y).groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(x) * F.col(x)).alias("xx"))
    return out.select(*(by or []), "n", (F.col("xy") / F.nullif("xx", F.lit(0.0))).alias("coef"))


def clustered_slope(rows: DataFrame, x: str, y: str, one: list[str], two: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, n, n_one, coef, se, t, p): slopes without intercept whose errors cluster two ways, all groups of `by` at once.

    The variance is V(one) + V(two) - V(both); where that is not positive, se, t and p are null.  The three cluster
    sums are grouping sets of one pass over the scores; p is two-sided, of the normal distribution.
    """
    by = by or []
    rows = complete(rows, x, y)
    fits = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(x) * F.col(x)).alias("xx"))
    fits = fits.withColumn("coef", F.col("xy") / F.nullif("xx", F.lit(0.0)))
    on = [F.col(f"_r_{c}").eqNullSafe(F.col(f"_f_{c}")) for c in by]
    scored = rows.select(*[F.col(c).alias(f"_r_{c}") for c in by], *one, *two, x, y).join(
        fits.select(*[F.col(c).alias(f"_f_{c}") for c in by], "coef", "n", "xx"), on or F.lit(True)
    )  # fits: a row for each group of by
    u = (F.col(x) * (F.col(y) - F.col("coef") * F.col(x))).alias("u")
    keys = [F.col(f"_r_{c}").alias(c) for c in by]
    sums = scored.select(*keys, *one, *two, u).groupingSets([[*by, *one], [*by, *two], [*by, *one, *two]], *by, *one, *two).agg(F.sum("u").alias("u"), F.grouping_id().alias("_g"))
    meat = sums.groupBy(*by, "_g").agg((F.sum(F.col("u") * F.col("u")) * F.count(F.lit(1)) / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))).alias("v"), F.count(F.lit(1)).alias("g"))
    first = (1 << len(two)) - 1  # grouping id: bits of the columns that are summed over
    second = ((1 << len(one)) - 1) << len(two)
    total = meat.groupBy(*by).agg(F.sum(F.when(F.col("_g") == 0, -F.col("v")).otherwise(F.col("v"))).alias("v"), F.max(F.when(F.col("_g") == first, F.col("g"))).alias("n_one"), F.max(F.when(F.col("_g") == second, F.col("g"))).alias("n_two"))
    both = fits.join(total.select(*[F.col(c).alias(f"_t_{c}") for c in by], "v", "n_one", "n_two"), [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in by] or F.lit(True))
    out = both.withColumn("se", F.when(F.col("v") > 0, F.sqrt("v") / F.col("xx"))).withColumn("t", F.col("coef") / F.col("se"))
    return out.select(*by, "n", "n_one", "coef", "se", "t", normal_two_sided(F.col("t")).alias("p"))


def t_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean over periods with t and the two-sided p of Student's t (null under 3 or without variation)."""
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    out = out.withColumn("t", F.when((F.col("n") >= 3) & (F.col("sd") > 0), F.col("mean") / (F.col("sd") / F.sqrt(F.col("n").cast("double")))))
    return out.select(*by, "n", "mean", "t", t_two_sided(F.col("t"), F.col("n") - 1).alias("p"))


def permutation(totals: DataFrame, actual: DataFrame, by: list[str], key: list[str], value: str, draws: int, k: int, seed: int = 0) -> DataFrame:
    """Random k of each period's pool against the pick that was made: totals (by, key, value), actual (actual).

    Sums are drawn per (period, pair), never per day.
    """
    picks = random_subsets(totals, by, key, draws, k, seed)
    return against(picks.groupBy("draw").agg(F.sum(value).alias("v")), actual)


def against(drawn: DataFrame, actual: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Where actual (by, actual) stands among the draws (by, v); missing values of v do not count."""
    by = by or []
    rows = drawn.filter("v IS NOT NULL")
    out = rows.join(F.broadcast(actual), by) if by else rows.crossJoin(F.broadcast(actual))  # one row, or one a measure
    return out.groupBy(*by).agg(
        F.count(F.lit(1)).alias("draws"), F.first("actual").alias("actual"), F.avg("v").alias("random_mean"), F.stddev_pop("v").alias("random_std"),
        F.percentile("v", F.lit(0.05)).alias("p5"), F.percentile("v", F.lit(0.5)).alias("p50"), F.percentile("v", F.lit(0.95)).alias("p95"),
        (F.avg(F.when(F.col("v") < F.col("actual"), 1.0).otherwise(0.0)) * 100).alias("percentile"),
        ((F.sum(F.when(F.col("v") >= F.col("actual"), 1).otherwise(0)) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"),
    )


def measures(daily: DataFrame, by: list[str], value: str, capital: float) -> DataFrame:
    """(by, measure, v): net profit, yearly Sharpe and largest drawdown % of daily profits on fixed capital, as rows."""
    w = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0) if by else Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = daily.withColumn("_eq", F.lit(capital) + F.sum(value).over(w))
    rows = rows.withColumn("_dd", F.col("_eq") / F.max("_eq").over(w) - 1)
    out = rows.groupBy(*by).agg(F.sum(value).alias("net"), F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"), (F.min("_dd") * 100).alias("dd"))
    sharpe = F.when(F.col("sd") > 1e-12, F.col("m") / F.col("sd") * F.sqrt(F.lit(252.0)))
    named = F.array(*[F.struct(F.lit(n).alias("measure"), c.alias("v")) for n, c in (("net", F.col("net")), ("sharpe", sharpe), ("max_drawdown_pct", F.col("dd")))])
    return out.select(*by, F.explode(named).alias("m")).select(*by, "m.measure", "m.v")


def permutation_daily(pool: DataFrame, chosen: DataFrame, daily: DataFrame, by: list[str], key: list[str], value: str, draws: int = 5000, capital: float = 100_000.0, seed: int = 0, keyed: bool = True) -> DataFrame:
    """Net profit, Sharpe and drawdown of random picks against the ones made: pool (by, key, k), chosen (by, key), daily (by, key, t, value).

    k pairs are drawn for each period, by keyed permutations of its places (keyed) or as the first in order of a hash (which sorts
    pool x draws rows).  A draw's daily profit is the sum over its pairs, taken by masked_sums.
    """
    rows = numbered(pool, by, key)
    if keyed:
        picks = keyed_places(rows.groupBy(*by).agg(F.first("m").alias("m"), F.max("k").alias("k")), by, draws, seed)
    else:
        out = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
        text = F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), *[F.col(c).cast("string") for c in [*by, *key]])
        place = F.row_number().over(Window.partitionBy(*by, "draw").orderBy(F.md5(text.cast("binary")), *key))
        picks = out.withColumn("pick", place).filter(F.col("pick") <= F.col("k")).groupBy(*by, "draw").agg(F.sort_array(F.collect_list("pos")).alias("places"))
    drawn = masked_sums(picks, rows.select(*by, *key, "pos"), daily, by, key, value)
    real = chosen.join(daily, [*by, *key]).groupBy("t").agg(F.sum(value).alias("v"))
    return against(measures(drawn, ["draw"], "v", capital), measures(real, [], "v", capital).withColumnRenamed("v", "actual"), ["measure"])


def masked_sums(picks: DataFrame, places: DataFrame, daily: DataFrame, by: list[str], key: list[str], value: str, block: int = 1024, together: int = 64, spread: int = 16) -> DataFrame:
    """(draw, t, v): sums of value over the rows a draw picked, picks (by, draw, places) of places (by, key, pos), daily (by, key, t, value).

    The product of masks and days is taken in blocks: the values of a day at `block` places are one array, the picks of `together` draws
    at those places are another, and where they meet each sum reads its picks from the array.  So daily rows are never repeated by draws,
    and what is shuffled after is a row per draw, day and block.  A period's days are dealt to `spread` keys, which its picks go to all.
    Days on which no picked row has a value are left out.
    """
    dealt = [*by, "_block", "_deal"]
    days = daily.filter(F.col(value).isNotNull()).join(places, [*by, *key]).select(*by, "t", F.expr(f"pos div {block}").alias("_block"), (F.col("pos") % block).cast("int").alias("_p"), F.pmod(F.hash("t"), F.lit(spread)).alias("_deal"), F.col(value).cast("double").alias("_v"))
    days = days.groupBy(*dealt, "t", "_p").agg(F.sum("_v").alias("_v")).groupBy(*dealt, "t").agg(F.sort_array(F.collect_list(F.struct("_p", "_v"))).alias("_e"))
    gap = lambda e, i: F.concat(F.array_repeat(F.lit(None).cast("double"), e["_p"] - F.when(i > 0, F.get("_e", i - 1)["_p"]).otherwise(F.lit(-1)) - 1), F.array(e["_v"]))
    days = days.select(*dealt, "t", F.flatten(F.transform("_e", gap)).alias("_values"))
    split = picks.withColumn("_block", F.explode(F.array_distinct(F.transform("places", lambda p: F.floor(p / block).cast("long")))))
    mine = F.transform(F.filter("places", lambda p: F.floor(p / block) == F.col("_block")), lambda p: (p % block).cast("int"))
    masks = split.groupBy(*by, "_block", F.expr(f"draw div {together}").alias("_together")).agg(F.collect_list(F.struct("draw", mine.alias("at"))).alias("_draws"))
    masks = masks.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))

    def summed(d):
        start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
        add = lambda s, p: F.when(F.get("_values", p).isNull(), s).otherwise(F.struct((s["s"] + F.get("_values", p)).alias("s"), (s["n"] + 1).alias("n")))
        return F.struct(d["draw"].alias("draw"), F.aggregate(d["at"], start, add).alias("sum"))

    met = masks.join(days, dealt).select("t", F.explode(F.transform("_draws", summed)).alias("_d"))
    return met.filter("_d.sum.n > 0").groupBy("_d.draw", "t").agg(F.sum("_d.sum.s").alias("v"))


#: Cumulative probabilities of the Poisson distribution with mean 1 at 0 to 9; what is above counts as 10.
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(j + 1)) for j in range(10))


def bootstrap_sharpe(daily: DataFrame, by: list[str], value: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """2.5 and 97.5 % of resampled Sharpe ratios, for groups of 20 rows or more: (by, low, high).

    A row's weight in a draw is Poisson with mean 1: a uniform number from the row's hash (of seed, by and t) by the draw's two
    random keys picks it.  So a draw is three sums of weights and weighted powers, which merge from any partitioning, and no
    group is ever in one place.  Values are taken less the group's mean before they are squared.  Null and NaN count as missing;
    draws without variation do not count; rows that agree in by and t have the same weights.
    """
    rows = daily.select(*by, "t", F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    known = rows.groupBy(*by).agg(F.avg("_v").alias("_m"), F.count(F.lit(1)).alias("_n")).filter("_n >= 20")
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    rows = rows.join(known.select(*[F.col(c).alias(f"_k_{c}") for c in by], "_m"), on).select(*by, "t", "_m", (F.col("_v") - F.col("_m")).alias("_v"))
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in [*by, "t"]]).cast("binary"))
    rows = rows.withColumn("_h", F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") % PRIME)
    keys = [hashlib.md5(f"{seed}|{i}".encode()).hexdigest() for i in range(1, draws + 1)]  # two numbers a draw: part of the plan, like draws itself
    first, second = (F.lit([int(k[at : at + 8], 16) % PRIME for k in keys]).cast("array<bigint>") for at in (0, 8))
    each = rows.withColumn("_d", F.explode(F.arrays_zip(F.sequence(F.lit(1), F.lit(draws)).alias("draw"), first.alias("a"), second.alias("b"))))
    u = (F.col("_h") * F.col("_d.a") + F.col("_d.b")) % PRIME
    weight = F.lit(0)
    for p in POISSON:
        weight = weight + F.when(F.col("_u") >= math.ceil(p * PRIME), 1).otherwise(0)
    each = each.select(*by, F.col("_d.draw").alias("_draw"), "_m", "_v", u.alias("_u")).select(*by, "_draw", "_m", "_v", weight.cast("double").alias("_w"))
    sums = each.groupBy(*by, "_draw").agg(F.first("_m").alias("_m"), F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.col("_v")).alias("_t"), F.sum(F.col("_w") * F.col("_v") * F.col("_v")).alias("_q"))
    mean = F.col("_t") / F.col("_n")
    sd = F.when(F.col("_n") > 1, F.sqrt(F.greatest((F.col("_q") - F.col("_t") * mean) / (F.col("_n") - 1), F.lit(0.0))))
    sharpe = F.when(sd > 1e-12, (F.col("_m") + mean) / sd * F.sqrt(F.lit(252.0)))
    out = sums.select(*by, sharpe.alias("_s")).filter("_s IS NOT NULL")
    return out.groupBy(*by).agg(F.percentile("_s", F.lit(0.025)).alias("low"), F.percentile("_s", F.lit(0.975)).alias("high"))


def exit_table(trades: DataFrame, reason: str = "why") -> DataFrame:
    """Share, win rate, days, mean and total profit per exit reason."""
    n = F.count(F.lit(1))
    out = trades.groupBy(reason).agg(n.alias("n_trades"), F.avg(F.when(F.col("net") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("days_held").alias("avg_days"), F.avg("net").alias("avg_net"), F.sum("net").alias("total_net"))
    return out.withColumn("share", F.col("n_trades") / F.sum("n_trades").over(Window.partitionBy(F.lit(1))))
