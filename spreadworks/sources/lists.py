"""Lists that steer a study: groups of tickers, pairs, grids, candidate pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def groups_table(spark: SparkSession, groups: dict[str, list[str]]) -> DataFrame:
    """(ticker, grp) of named groups; a ticker in two groups is an error."""
    rows = [(t.strip().upper(), g) for g, ts in groups.items() for t in ts]
    twice = {t for t, _ in rows if sum(t == u for u, _ in rows) > 1}
    if twice:
        raise ValueError(f"in several groups: {sorted(twice)}")
    return spark.createDataFrame(rows, "ticker string, grp string")


def brand_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, grp): the built-in universe of the sales tables, brands by number modulo 5."""
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("ticker")).distinct()
    return brands.select("ticker", (F.regexp_extract("ticker", r"(\d+)$", 1).cast("int") % 5).alias("grp"))


def group_sizes(groups: DataFrame) -> DataFrame:
    """(grp, n_tickers, n_pairs): pairs within each group."""
    n = F.count_distinct("ticker")
    return groups.groupBy("grp").agg(n.alias("n_tickers"), (n * (n - 1) / 2).cast("long").alias("n_pairs"))


def ungrouped(panel: DataFrame, groups: DataFrame) -> DataFrame:
    """Tickers of a panel that no group names."""
    return panel.select("ticker").distinct().join(groups.select("ticker").distinct(), "ticker", "left_anti")


def parse_pairs(text: str) -> list[tuple[str, str]]:
    """'A/B, C/D' as pairs: each needs one slash and two different tickers."""
    out = []
    for item in filter(None, (x.strip() for x in text.split(","))):
        a, slash, b = (x.strip().upper() for x in item.partition("/"))
        if not slash or not a or not b or "/" in b:
            raise ValueError(f"not a pair: {item!r}")
        if a == b:
            raise ValueError(f"a pair needs two tickers: {item!r}")
        out.append((a, b))
    if not out:
        raise ValueError("no pairs given")
    return out


def parse_grid(text: str) -> list[float]:
    """'1.5, 2, 2.5' as ascending distinct numbers."""
    values = sorted({float(x) for x in text.split(",") if x.strip()})
    if not values:
        raise ValueError("an empty grid")
    return values


def read_candidates(spark: SparkSession, path: str, tickers: DataFrame) -> DataFrame:
    """A screener's pairs (y, x, ..) from CSV, restricted to loaded tickers; columns keep the types they look like."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    t = tickers.select("ticker").distinct()
    return rows.join(t.withColumnRenamed("ticker", "y"), "y", "left_semi").join(t.withColumnRenamed("ticker", "x"), "x", "left_semi")
