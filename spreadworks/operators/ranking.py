"""Ranks, quintiles, corrections for multiple tests, rank correlations, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def average_rank(column: str, by: list[str]):
    """Ranks from 1, ties sharing their mean rank; null for a null, which takes no rank."""
    order = Window.partitionBy(*by).orderBy(F.col(column).asc_nulls_last())
    rank = F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*by, column)) - 1) / F.lit(2.0)
    return F.when(F.col(column).isNotNull(), rank)


def percent_rank_of(column: str, by: list[str], descending: bool = False):
    """Average rank over the count of values, as a share; null for a null."""
    n = F.count(column).over(Window.partitionBy(*by))
    r = average_rank(column, by)
    return (n + 1 - r) / n if descending else r / n


def rank_ic(rows: DataFrame, by: list[str], metric: str, outcome: str, least: int = 8) -> DataFrame:
    """Spearman correlation per group of the rows that have both; null under `least` of them or without variation."""
    good = rows.filter(F.col(metric).isNotNull() & F.col(outcome).isNotNull())
    good = good.withColumn("_a", average_rank(metric, by)).withColumn("_b", average_rank(outcome, by))
    out = good.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_samp("_a", "_b").alias("c"), F.stddev_samp("_a").alias("sa"), F.stddev_samp("_b").alias("sb"))
    return out.select(*by, "n", F.when((F.col("n") >= least) & (F.col("sa") > 0) & (F.col("sb") > 0), F.col("c") / (F.col("sa") * F.col("sb"))).alias("ic"))


def quintile(column: str, by: list[str], n: int = 5, least: int = 1):
    """1 to n by floor((average rank - 1) n / count): ties share a bucket; null for a null, and under `least` values or without variation (least > 1)."""
    w = Window.partitionBy(*by)
    count = F.count(column).over(w)
    bucket = F.when(F.col(column).isNotNull(), F.least(F.floor((average_rank(column, by) - 1) * n / count), F.lit(n - 1)).cast("int") + 1)
    return bucket if least <= 1 else F.when((count >= least) & (F.min(column).over(w) < F.max(column).over(w)), bucket)


def quantile_cut(column: str, by: list[str], tie: list[str], n: int = 5):
    """1 to n by right-closed, linearly interpolated edges of the ranks in order of first appearance."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(column, *tie))
    count = F.count(column).over(Window.partitionBy(*by))
    return F.greatest(F.lit(1), F.ceil((r - 1) * n / (count - 1))).cast("int")


def zscore_within(column: str, by: list[str]):
    w = Window.partitionBy(*by)
    return (F.col(column) - F.avg(column).over(w)) / F.nullif(F.stddev_pop(column).over(w), F.lit(0.0))


def corrected(rows: DataFrame, by: list[str], p: str, tie: list[str], null_is_one: bool = False) -> DataFrame:
    """Bonferroni, Benjamini-Hochberg and Holm p-values; a null p is 1, or stays out of the family."""
    rows = rows.withColumn("_p", F.coalesce(p, F.lit(1.0)) if null_is_one else F.col(p))
    family = F.count("_p").over(Window.partitionBy(*by))
    order = Window.partitionBy(*by).orderBy(F.col("_p").asc_nulls_last(), *tie)
    rows = rows.withColumn("_m", family).withColumn("_k", F.row_number().over(order))
    step = F.min(F.col("_p") * F.col("_m") / F.col("_k")).over(order.rowsBetween(0, Window.unboundedFollowing))
    run = F.max(F.col("_p") * (F.col("_m") - F.col("_k") + 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    known = F.col("_p").isNotNull()
    return (
        rows.withColumn("p_bonferroni", F.when(known, F.least(F.lit(1.0), F.col("_p") * F.col("_m"))))
        .withColumn("p_bh", F.when(known, F.least(F.lit(1.0), step))).withColumn("p_holm", F.when(known, F.least(F.lit(1.0), run)))
        .drop("_p", "_m", "_k")
    )


def top_k(rows: DataFrame, by: list[str], order: list, k: int, name: str = "place") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def capped_top_k(rows: DataFrame, by: list[str], score: str, k: int, per_ticker: int) -> DataFrame:
    """Adds place: best score first (NaN, then null scores last; ties by y, x), skipping pairs whose tickers are used up.

    A pair stands once in a group.  The walk over a group sees a number of rows that k and per_ticker bound, whatever the pool:
    k pairs use up at most 2k / per_ticker tickers, so before a kept pair its y (and its x) has at most per_ticker - 1 kept pairs
    in that place and one skipped pair for each ticker used up; rows further down their y or x are never kept.  Of the others
    those skipped before the k-th kept pair touch a ticker used up, which has at most `most` rows in either place.
    """
    if k < 1 or per_ticker < 1:
        return rows.withColumn("place", F.lit(0)).filter(F.lit(False))
    spent = 2 * k // per_ticker
    most = per_ticker + spent
    unknown = F.isnan(F.col(score).cast("double"))
    order = [F.col(score).isNull(), F.coalesce(unknown, F.lit(False)), F.col(score).desc(), F.col("y").asc_nulls_last(), F.col("x").asc_nulls_last()]
    for ticker in ("y", "x"):
        rows = top_k(rows, [*by, ticker], order, most, "_at").drop("_at")
    columns = rows.columns
    rows = top_k(rows, by, order, k + spent * 2 * most, "_at")
    walk = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", "y", "x"))).alias("_walk"), F.collect_list(F.struct("_at", *columns)).alias("_rows"))
    nothing = F.struct(F.array().cast("array<int>").alias("kept"), F.array().cast(f"array<{rows.schema['y'].dataType.simpleString()}>").alias("used"))

    def step(state, row):
        free = [F.size(F.filter(state["used"], ticker.eqNullSafe)) < per_ticker for ticker in (row["y"], row["x"])]
        taken = F.struct(F.concat(state["kept"], F.array(row["_at"])).alias("kept"), F.concat(state["used"], F.array(row["y"], row["x"])).alias("used"))
        return F.when((F.size(state["kept"]) < k) & free[0] & free[1], taken).otherwise(state)

    kept = walk.select("_rows", F.aggregate("_walk", nothing, step, lambda s: s["kept"]).alias("_kept"))
    out = kept.select("_kept", F.explode("_rows").alias("_row")).withColumn("place", F.array_position("_kept", F.col("_row._at")).cast("int"))
    return out.filter("place > 0").select(*[F.col("_row").getField(c).alias(c) for c in columns], "place")


def random_subsets(rows: DataFrame, by: list[str], key: list[str], draws: int, k: int, seed: int = 0) -> DataFrame:
    """k rows per group and draw without replacement, ordered by a hash of (seed, draw, row): the same on any partitioning."""
    out = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    text = F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), *[F.col(c).cast("string") for c in [*by, *key]])
    return top_k(out, [*by, "draw"], [F.md5(text.cast("binary")), *key], k, "pick")


#: Fixed value: the prime 2^31 - 1, below which products of two numbers fit 64 bits.
PRIME = 2147483647


def numbered(pool: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Adds pos, the place of a row in its group (from 0, in order of key), and m, the rows of the group."""
    w = Window.partitionBy(*by)
    return pool.withColumns({"pos": (F.row_number().over(w.orderBy(*key)) - 1).cast("long"), "m": F.count(F.lit(1)).over(w)})


def keyed_places(groups: DataFrame, by: list[str], draws: int, seed: int = 0) -> DataFrame:
    """(by, draw, places): for each draw k of the places 0..m-1 of groups (by, m, k), without order, repeats or sorting.

    A draw has a permutation of its own of the cells of a grid of a x b >= m places (a = ceil(sqrt m)): four rounds shift one
    coordinate by a random linear function of the other, their eight keys being the SHA-256 of (seed, draw, by).  It is followed from
    cell 0 on, cells past m are passed over, until k are found: at most k + a * b - m < k + a steps, whatever m.  k is at most m.
    """
    a = (F.floor(F.sqrt((F.col("m") - 1).cast("double"))) + 1).cast("long")
    g = groups.filter("m > 0").withColumn("_a", a).withColumn("_b", F.expr("(m + _a - 1) div _a")).withColumn("k", F.least("k", "m").cast("long"))
    g = g.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), *[F.col(c).cast("string") for c in by]).cast("binary"), 256)
    g = g.withColumn("_h", digest).withColumn("_keys", F.array(*[F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long") % PRIME for i in range(8)]))

    def cell(i):
        at = F.struct((i % F.col("_a")).alias("l"), F.floor(i / F.col("_a")).cast("long").alias("r"))
        rounds = F.array(*[F.struct(F.lit(j % 2 == 0).alias("left"), F.col("_keys")[2 * j].alias("u"), F.col("_keys")[2 * j + 1].alias("v")) for j in range(4)])

        def turn(s, r):
            shift = (F.when(r["left"], s["r"]).otherwise(s["l"]) * r["u"] + r["v"]) % PRIME
            return F.struct(F.when(r["left"], (s["l"] + shift) % F.col("_a")).otherwise(s["l"]).alias("l"), F.when(r["left"], s["r"]).otherwise((s["r"] + shift) % F.col("_b")).alias("r"))

        return F.aggregate(rounds, at, turn, lambda s: s["r"] * F.col("_a") + s["l"])

    steps = F.when(F.col("k") > 0, F.sequence(F.lit(0).cast("long"), F.expr("k + _a * _b - m - 1"))).otherwise(F.array().cast("array<bigint>"))
    return g.select(*by, "draw", F.slice(F.filter(F.transform(steps, cell), lambda p: p < F.col("m")), 1, F.col("k").cast("int")).alias("places"))


def keyed_subsets(pool: DataFrame, by: list[str], key: list[str], draws: int, k: int, seed: int = 0) -> DataFrame:
    """k rows per group and draw without replacement, by keyed_places: a draw costs k + sqrt(pool) steps, and nothing is ordered by draws."""
    rows = numbered(pool, by, key)
    groups = rows.groupBy(*by).agg(F.first("m").alias("m"), F.lit(k).cast("long").alias("k"))
    picks = keyed_places(groups, by, draws, seed).select(*by, "draw", F.explode("places").alias("pos"))
    return picks.join(rows.drop("m"), [*by, "pos"]).drop("pos")
