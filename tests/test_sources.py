import pytest
from pyspark.sql import functions as F

from spreadworks.operators import clean
from spreadworks.sources import panel

HEAD = "Ticker,AAA,,BBB,\nPrice,Close,Volume,Close,Volume\nDate,,,,\n"


@pytest.fixture
def write(tmp_path):
    def f(name, text):
        p = tmp_path / name
        p.write_text(text)
        return str(p)

    return f


def closes(df):
    return {(str(r["date"]), r["ticker"]): r["close"] for r in df.collect()}


WANT = {("2024-01-01", "AAA"): 1.0, ("2024-01-01", "BBB"): 3.0, ("2024-01-02", "AAA"): 2.0, ("2024-01-02", "BBB"): None}


def test_three_header_carries_tickers_and_drops_bad_rows(spark, write):
    path = write("a.csv", HEAD + "2024-01-01,9,1,9,1\n2024-01-01,1,1,3,1\nbad,5,5,5,5\n2024-01-02,2,1,x,1\n")
    assert closes(panel.read_prices(spark, path)) == WANT


def test_long_flat_and_adjusted_agree(spark, write):
    long = write("l.csv", "Date,Ticker,Close\n2024-01-01,AAA,1\n2024-01-01,BBB,3\n2024-01-02,AAA,2\n2024-01-02,BBB,\n")
    flat = write("f.csv", "Date,Close_AAA,Close_BBB\n2024-01-01,1,3\n2024-01-02,2,\n")
    plain = write("p.csv", "Date,AAA,BBB\n2024-01-01,1,3\n2024-01-02,2,oops\n")
    adjusted = write("j.csv", "Price,Adj Close,Adj Close,Close,Close\nTicker,AAA,BBB,AAA,BBB\n2024-01-01,1,3,9,9\n2024-01-02,2,,9,9\n")
    for path in (long, flat, plain, adjusted):
        assert closes(panel.read_prices(spark, path)) == WANT, path


def test_undated_rows_become_week_days(spark, write):
    path = write("u.csv", "AAA,BBB\nClose*,Close\n1,3\n2,\n")
    assert closes(panel.read_undated(spark, path, "2024-01-01")) == WANT
    with pytest.raises(ValueError):
        panel.read_undated(spark, write("v.csv", "AAA,BBB\nOpen,Open\n1,2\n"), "2024-01-01")


def test_files_without_dates_get_week_days(spark, write):
    three = write("t.csv", HEAD + ",1,1,3,1\n,2,1,x,1\n")
    assert closes(panel.read_prices(spark, three, "2024-01-01")) == WANT
    assert closes(panel.read_three_header(spark, three, ("close",), "2023-12-30", cutoff="2024-01-01")) == {k: v for k, v in WANT.items() if k[0] == "2024-01-01"}
    assert panel.read_three_header(spark, three, ("close",)).count() == 0
    plain = write("q.csv", "AAA,BBB\n1,3\n2,\n")
    assert closes(panel.read_prices(spark, plain, "2024-01-01")) == WANT
    adjusted = write("k.csv", "Price,Adj Close,Adj Close,Close\nTicker,AAA,BBB,CCC\n0,1,3,9\n1,2,,9\n")
    assert closes(panel.read_prices(spark, adjusted, "2024-01-01")) == WANT


def test_single_headers_want_dates_in_nine_of_ten_rows_and_keep_the_last_of_a_date(spark, write):
    days = [f"2024-01-{i:02d},{i}" for i in range(1, 10)]
    good = write("m.csv", "Date,AAA\n" + "\n".join(["2024-01-01,77", *days, "oops,5"]) + "\n")
    assert closes(panel.read_prices(spark, good)) == {(f"2024-01-{i:02d}", "AAA"): float(i) for i in range(1, 10)}
    with pytest.raises(ValueError):
        panel.read_prices(spark, write("n.csv", "Date,AAA\n2024-01-01,1\noops,2\n"))


def test_rows_are_numbered_through_the_partitions(spark, write):
    path = write("w.csv", "AAA\nClose\n" + "\n".join(str(i) for i in range(2000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.csv(path).rdd.getNumPartitions() > 5
        got = panel.read_undated(spark, path, "2024-01-06").orderBy("date").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert [r["close"] for r in got] == [float(i) for i in range(2000)]
    assert str(got[0]["date"]) == "2024-01-08" and all(r["date"].weekday() < 5 for r in got) and len({r["date"] for r in got}) == 2000


def test_groups_refuse_duplicates(spark, write):
    assert panel.read_groups(spark, write("g.csv", "ticker,group\nA,x\nB,y\n")).count() == 2
    with pytest.raises(ValueError):
        panel.read_groups(spark, write("h.csv", "ticker,group\nA,x\nA,y\n"))


def test_cleaning_rules(spark):
    rows = [("A", 0, f"2024-01-{i:02d}", None if i in (5, 6) else float(i), 1.0) for i in range(1, 21)]
    rows += [("B", 0, f"2024-01-{i:02d}", None if 5 <= i <= 9 else float(i), None) for i in range(1, 21)]
    rows += [("C", 0, f"2024-01-{i:02d}", 0.0 if i == 3 else 1.0, 1.0) for i in range(1, 21)]
    rows += [("D", 0, "2024-01-01", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, grp int, date string, close double, volume double").withColumn("date", __import__("pyspark.sql.functions", fromlist=["x"]).to_date("date"))
    out = clean.clean(df, most_missing=0.3, limit=3)
    got = {(r["ticker"], r["date"].day): (r["close"], r["volume"], r["t"]) for r in out.collect()}
    assert {t for t, _ in got} == {"A", "B"}
    assert got["A", 6] == (4.0, 1.0, 5) and got["B", 7] == (4.0, 0.0, 6)
    assert ("A", 8) not in got and ("A", 9) not in got and got["A", 10][2] == 7
    assert clean.clean(df.limit(0)).count() == 0


def test_bars_stream_like_a_batch(spark, tmp_path):
    from spreadworks.streaming.bars import bars

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.par*")
    q = bars(stream, "1 day", "30 days").writeStream.outputMode("complete").format("memory").queryName("bars").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(repr, spark.table("bars").collect())) == sorted(map(repr, bars(events, "1 day").collect()))


@pytest.fixture
def sales(spark, tmp_path):
    def f(items):
        spark.createDataFrame([(1, "Brand#11")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
        rows = spark.createDataFrame(items, "day string, l_extendedprice double, l_quantity double")
        rows = rows.selectExpr("1L AS l_partkey", "l_quantity", "l_extendedprice", "CAST(day AS timestamp_ntz) AS l_shipdate")
        rows.write.parquet(f"{tmp_path}/lineitem.parquet")
        return str(tmp_path)

    return f


def test_the_date_of_a_sale_has_no_time_zone(spark, sales):
    """Kiritimati left out 1994-12-31; a sale of that day is one of December all the same."""
    d, zone = sales([("1994-12-31 00:00:00", 1.0, 1.0), ("1994-12-31 23:59:59", 3.0, 1.0)]), spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Pacific/Kiritimati")
    try:
        got = {p: [(str(r["date"]), r["close"]) for r in panel.sales_panel(spark, d, p).collect()] for p in ("day", "week", "month", "quarter", "year")}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == {p: [(day, 2.0)] for p, day in {"day": "1994-12-31", "week": "1994-12-26", "month": "1994-12-01", "quarter": "1994-10-01", "year": "1994-01-01"}.items()}


def test_cents_are_those_of_round(spark):
    """Halves go away from zero, neighbours of a half do not, large and missing values stay."""
    odd = [0.0, -0.0, 0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.49999999999999994, 1234567.4999999998, 4503599627370497.0, -9007199254740993.0, 1e18, 33.33 * 100, 1.005 * 100, 1.115 * 100, None]
    rows = spark.createDataFrame([(x,) for x in odd], "x double").select(panel.whole(F.col("x")).alias("got"), F.round("x").cast("long").alias("want"), "x").collect()
    assert [r for r in rows if r["got"] != r["want"]] == [] and rows[2]["got"] == 1 and rows[6]["got"] == -3 and rows[-1]["got"] is None
