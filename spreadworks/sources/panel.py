"""Price panels: long rows (ticker, date, open, close, volume, grp), from CSV layouts or from sales tables."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def whole(x):
    """The double x as a long, halves away from zero: what round gives, which makes a decimal of each value on the way."""
    down = x.cast("long")
    rest = x - down
    return down + F.when(rest.between(0.5, 1), 1).when(rest.between(-1, -0.5), -1).otherwise(0)


#: Parts beyond which they are not left to a broadcast, and parts that one task's hash map may hold.
MANY_PARTS, PARTS_A_TASK = 2_000_000, 2_000_000


def sales_panel(spark: SparkSession, sf_dir: str, period: str = "week") -> DataFrame:
    """Brand prices per period (day, week, month, quarter, year) from line items: close = money / quantity, in whole cents so that sums are exact.

    What is done for each line item is plain arithmetic on doubles and days; a time zone has no say in the date.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    if MANY_PARTS < parts.count() <= PARTS_A_TASK * int(spark.conf.get("spark.sql.shuffle.partitions")):
        parts = parts.hint("shuffle_hash")  # a merge join would sort all line items
    day = F.col("l_shipdate").cast("date")
    rows = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("ticker"),
        (day if period == "day" else F.trunc(day, period)).alias("date"),
        whole(F.col("l_extendedprice") * 100).alias("cents"),
        F.col("l_quantity").cast("long").alias("quantity"),
    )
    found = rows.groupBy("ticker", "date").agg(F.sum("cents").alias("cents"), F.sum("quantity").alias("quantity"))
    number = F.regexp_extract("ticker", r"(\d+)$", 1).cast("int")
    return found.select(
        "ticker", (number % 5).alias("grp"), "date",
        (F.col("cents") / F.lit(100.0) / F.col("quantity")).alias("close"), F.col("quantity").cast("double").alias("volume"),
    )


def week_day(start: str, t):
    """The t-th week day (from 0) from start on, as an expression."""
    first = f"date_add(date'{start}', CASE weekday(date'{start}') WHEN 5 THEN 2 WHEN 6 THEN 1 ELSE 0 END)"
    t = t.cast("int")
    return F.date_add(F.expr(first), (t + 2 * F.floor((t + F.weekday(F.expr(first))) / 5)).cast("int"))


def business_days(spark: SparkSession, start: str, n: int) -> DataFrame:
    """(t, date): n week days from start on."""
    return spark.range(n).select(F.col("id").cast("int").alias("t"), week_day(start, F.col("id")).alias("date"))


def in_file_order(raw: DataFrame) -> DataFrame:
    """raw with _n, the place of each row in the file from 0: places within a partition plus the rows of the partitions before it, so no task reads all rows."""
    raw = raw.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition of the file
    sizes = raw.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return raw.join(F.broadcast(sizes), "_part").withColumn("_n", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def parsed(column: str):
    return F.to_date(F.expr(f"try_to_timestamp(`{column}`)"))


def dated(rows: DataFrame, column: str, start: str | None, least: float, strict: bool = False, required: bool = False) -> DataFrame:
    """rows (with _n, from 0) with _date, the last row of each date.

    Where a share of at least `least` (strict: more) of the rows has a date, the rest goes; otherwise rows are week days
    from start on, in file order, and have a column _rebuilt.  Without start dates are taken as they are; required: too few are an error.
    """
    if start is not None or required:
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.count(parsed(column)).alias("good")).first()
        share = found["good"] / found["n"] if found["n"] else 0.0
        if not (share > least if strict else share >= least):
            if required:
                raise ValueError(f"too few dates in column {column}")
            return rows.withColumn("_date", week_day(start, F.col("_n"))).withColumn("_rebuilt", F.lit(True))
    rows = rows.withColumn("_date", parsed(column)).filter("_date IS NOT NULL")
    last = F.row_number().over(Window.partitionBy("_date").orderBy(F.col("_n").desc()))
    return rows.withColumn("_last", last).filter("_last = 1").drop("_last")


def _head(spark: SparkSession, path: str, n: int) -> list[list[str]]:
    """The first n lines of a CSV as cells."""
    return list(csv.reader(r["value"] for r in spark.read.text(path).take(n)))


def clean_name(cell: str) -> str:
    return cell.replace("*", "").strip()


def _columns(tickers: list[str], fields: list[str], carry: bool) -> dict[tuple[str, str], int]:
    """(ticker, field) to column number; blank ticker cells carry the last one on; the first of duplicates counts."""
    out, last = {}, ""
    for i, (a, b) in enumerate(zip(tickers, fields, strict=False)):
        a, b = clean_name(a), clean_name(b).lower()
        if carry and not a:
            a = last
        last = a
        if i and a and b:
            out.setdefault((a, b), i)
    return out


def _unpivot(raw: DataFrame, columns: dict[tuple[str, str], int], date, names: tuple[str, ...]) -> DataFrame:
    """Long rows of a wide CSV; bad cells become null."""
    tickers = list(dict.fromkeys(t for t, _ in columns))
    rows = F.array(*[
        F.struct(F.lit(t).alias("ticker"), F.lit(i).alias("ord"), *[
            (F.col(f"_c{columns[t, n]}").try_cast("double") if (t, n) in columns else F.lit(None).cast("double")).alias(n.replace(" ", "_")) for n in names
        ]) for i, t in enumerate(tickers)
    ])
    out = raw.select(date.alias("date"), F.explode(rows).alias("r")).select("date", "r.*")
    for n in names:  # NaN and infinities count as missing
        c = n.replace(" ", "_")
        out = out.withColumn(c, F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)))
    return out


FIELDS = ("open", "high", "low", "close", "volume")


def read_three_header(spark: SparkSession, path: str, fields: tuple[str, ...] = FIELDS, start: str | None = None, cutoff: str | None = None) -> DataFrame:
    """Rows `Ticker,..`, `Price,..`, `Date,..` above the data; blank ticker cells carry on; bad dates go; of equal dates the last row stays.

    With start, a file without any date has week days from start on; with cutoff, later dates go.
    """
    head = _head(spark, path, 2)
    columns = _columns(head[0], head[1], carry=True)
    if not any(f == "close" for _, f in columns):
        raise ValueError("no Close column")
    raw = in_file_order(spark.read.csv(path, header=False)).withColumn("_n", F.col("_n") - 3).filter("_n >= 0")
    raw = dated(raw, "_c0", start, 0.0, strict=True)
    if cutoff is not None:
        raw = raw.filter(F.col("_date") <= F.lit(cutoff).cast("date"))
    return _unpivot(raw, columns, F.col("_date"), fields)


def read_adjusted(spark: SparkSession, path: str, start: str | None = None) -> DataFrame:
    """Two header levels in either order; where the file has Adj Close, its columns are the closes, else Close; of equal dates the last row stays.

    With start, rows are week days from start on unless over 90 % of them have a date; a third header row is a row without values.
    """
    head = _head(spark, path, 2)
    fields = {"adj close", "close", "open", "high", "low", "volume", "price"}
    top_is_field = sum(clean_name(c).lower() in fields for c in head[0]) > sum(clean_name(c).lower() in fields for c in head[1])
    tickers, names = (head[1], head[0]) if top_is_field else (head[0], head[1])
    columns = _columns(tickers, names, carry=not top_is_field)
    field = "adj close" if any(f == "adj close" for _, f in columns) else "close"
    closes = {(t, "close"): i for (t, f), i in columns.items() if f == field}
    if not closes:
        raise ValueError("no Close column")
    raw = in_file_order(spark.read.csv(path, header=False)).withColumn("_n", F.col("_n") - 2).filter("_n >= 0")
    return _unpivot(dated(raw, "_c0", start, 0.9, strict=True), closes, F.col("_date"), ("close",))


def read_undated(spark: SparkSession, path: str, start: str) -> DataFrame:
    """Two header rows and no dates: rows are week days from start on."""
    head = _head(spark, path, 3)
    if len(head[0]) != len(head[1]):
        raise ValueError("header rows differ in length")
    columns = {}
    for i, (a, b) in enumerate(zip(*head[:2], strict=True)):
        columns.setdefault((clean_name(a), clean_name(b).lower()), i)
    if not any(f == "close" for _, f in columns):
        raise ValueError("no Close column")
    if len(head) < 3:
        raise ValueError("no data rows")
    raw = in_file_order(spark.read.csv(path, header=False)).withColumn("_n", F.col("_n") - 2).filter("_n >= 0")
    return _unpivot(raw, columns, week_day(start, F.col("_n")), ("close",))


def read_long(spark: SparkSession, path: str) -> DataFrame:
    """`Date,Ticker,Close`."""
    raw = spark.read.csv(path, header=True)
    by = {c.lower(): c for c in raw.columns}
    return raw.select(F.to_date(F.expr(f"try_to_timestamp(`{by['date']}`)")).alias("date"), F.col(by["ticker"]).alias("ticker"), F.col(by["close"]).try_cast("double").alias("close")).filter("date IS NOT NULL")


DATE_NAMES = ("Date", "date", "Datetime", "datetime", "Timestamp", "timestamp")


def read_flat(spark: SparkSession, path: str, start: str | None = None) -> DataFrame:
    """`Date,Close_AAA,..`, `Date,Adj Close_AAA,..` or any `Date,AAA,..`; of equal dates the last row stays.

    A column named for dates must hold them in 90 % of the rows.  Else the first column does; with start, where it does
    not, every column is a price and rows are week days from start on.
    """
    raw = spark.read.csv(path, header=True)
    named = next((c for c in DATE_NAMES if c in raw.columns), None)
    rows = dated(in_file_order(raw), named or raw.columns[0], None if named else start, 0.9, required=named is not None)
    prices = [c for c in raw.columns if c != (named or raw.columns[0]) or "_rebuilt" in rows.columns]
    marked = {m[2]: c for c in prices if (m := re.match(r"(Adj Close|Close)_(.+)", c))}
    columns = marked or {c.strip(): c for c in prices}
    cells = F.array(*[F.struct(F.lit(t).alias("ticker"), F.lit(i).alias("ord"), F.col(f"`{c}`").try_cast("double").alias("close")) for i, (t, c) in enumerate(columns.items())])
    return rows.select(F.col("_date").alias("date"), F.explode(cells).alias("r")).select("date", "r.*")


def read_prices(spark: SparkSession, path: str, start: str | None = None) -> DataFrame:
    """Pick the layout by its header; start: the first week day of files without dates."""
    head = _head(spark, path, 3)
    first = [clean_name(c).lower() for c in head[0]]
    second = [clean_name(c).lower() for c in head[1]] if len(head) > 1 else []
    if {"date", "ticker", "close"} <= set(first):
        return read_long(spark, path)
    if "close" in second and start is not None and len(head) > 2 and not re.match(r"\d{4}-", head[2][0]) and first[0] not in ("ticker", "price", "date"):
        return read_undated(spark, path, start)
    if "adj close" in second or "adj close" in first or "close" in first:
        return read_adjusted(spark, path, start)
    return read_three_header(spark, path, ("close",), start) if "close" in second else read_flat(spark, path, start)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, grp); a ticker in two groups is an error."""
    rows = spark.read.csv(path, header=True).select(F.col("ticker"), F.col("group").alias("grp"))
    twice = rows.groupBy("ticker").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"ticker in several groups: {twice[0]['ticker']}")
    return rows


def completeness(panel: DataFrame, most_missing: float = 0.2, long_history: int = 52) -> DataFrame:
    """Per ticker: rows present, share missing of all dates, first date, and why it is not good."""
    dates = panel.select("date").distinct().agg(F.count(F.lit(1)).alias("n_dates"))
    found = panel.groupBy("ticker").agg(F.count("close").alias("n_present"), F.min(F.when(F.col("close").isNotNull(), F.col("date"))).alias("first_date"))
    out = found.crossJoin(F.broadcast(dates)).withColumn("missing", 1 - F.col("n_present") / F.col("n_dates"))
    reason = F.when(F.col("missing") >= 0.999, "no data").when(F.col("missing") > most_missing, "too many missing").when(F.col("n_present") < long_history, "short history").otherwise("ok")
    return out.withColumn("reason", reason)


def absent(panel: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted tickers that the panel lacks."""
    return wanted.select("ticker").distinct().join(panel.select("ticker").distinct(), "ticker", "left_anti")
