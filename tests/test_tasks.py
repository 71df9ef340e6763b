"""What costs seconds over few bytes runs in several tasks, however small adaptive execution takes its rows to be."""

import pytest
from pyspark.sql import functions as F

from spreadworks.operators import simulate, tradability

PAIR = ["y", "x"]


@pytest.fixture(scope="module")
def rows(spark):
    """Twelve pairs of 120 rows each whose spread is noise."""
    pair = F.col("id") % 12
    grid = spark.range(12 * 120).select(F.concat(F.lit("A"), pair).alias("y"), F.concat(F.lit("B"), pair % 3).alias("x"), (pair % 2).alias("fold"), F.floor(F.col("id") / 12).cast("int").alias("t"))
    noise = lambda *salt: F.pmod(F.xxhash64("y", "t", *map(F.lit, salt)), F.lit(1000)) / 500 - 1
    return grid.withColumn("px", 100 + F.col("t") * 0.1 + noise(1)).withColumn("py", 2 * F.col("px") + 5 * noise(2)).withColumn("z", 3 * noise(3))


def tasks(df):
    return df.select(F.spark_partition_id().alias("part")).distinct().count()


def test_machines_run_in_several_tasks(rows):
    assert tasks(simulate.engine_positions(rows, PAIR)) > 1


def test_unit_root_tests_run_in_several_tasks(rows, monkeypatch):
    found, of_series = [], tradability.unitroot.dickey_fuller

    def counted(df, *arguments, **named):
        found.append(tasks(df))
        return of_series(df, *arguments, **named)

    monkeypatch.setattr(tradability.unitroot, "dickey_fuller", counted)
    out = tradability.candidates(rows, ["fold"], "raw", significance=1.0, least=100, min_half_life=0.0, max_half_life=1e9, max_cost_to_move=1e9)
    assert len(found) == 2 and min(found) > 1 and out.count() == 12


def test_a_group_of_a_grid_has_all_its_cells(spark, rows):
    cells = spark.createDataFrame([(1.25, 0.25), (1.25, 0.5), (2.0, 0.25)], "entry double, exit double")
    out = simulate.grid_positions(rows.crossJoin(cells), PAIR)
    grouped = next(x for x in out._jdf.queryExecution().analyzed().toString().splitlines() if "FlatMapGroupsInArrow" in x)
    assert "entry" not in grouped.split("]")[0]
    for c in cells.collect():
        want = simulate.engine_positions(rows, PAIR, c["entry"], c["exit"])
        got = out.filter((F.col("entry") == c["entry"]) & (F.col("exit") == c["exit"]))
        pick = [*PAIR, "t", "target"]
        assert sorted(got.select(*pick).collect()) == sorted(want.select(*pick).collect())
