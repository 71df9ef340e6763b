from collections import Counter

import pytest
from llmcases import documents, words, write
from oracle import assert_same
from pyspark.sql import functions as F

from spreadworks.llm import mixing, sharding
from spreadworks.llm.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op5_sharding", "op9_mixing_sources"])
def test_same_as_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name], SMALL)


def test_mix_of_edge_cases_equals_sql(spark, tmp_path):
    assert_same(spark, mixing.op9_mixing_sources, ORACLES["op9_mixing_sources"], write(tmp_path / "t"))


@pytest.mark.parametrize("name", ["op5_sharding", "op9_mixing_sources"])
def test_empty_tables(spark, tmp_path, name):
    assert QUERIES[name](spark, write(tmp_path / "t", empty=True)).count() == 0


def brute_targets(sizes):
    """Water filling, one source at a time."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        rate = total / sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * rate >= 2 * sizes[s]]
        if not above:
            return target | {s: weight[s] * rate for s in open_}
        for s in above:
            target[s] = 2.0 * sizes[s]
            total -= target[s]
            open_.remove(s)
    return target


def test_targets_and_whole_texts(spark, tmp_path):
    rows = documents()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = brute_targets(dict(sizes))
    found = mixing.op9_mixing_sources(spark, write(tmp_path / "t")).select("*").collect()
    assert len(found) == len(rows)
    assert Counter(r["source_size"] for r in found) == Counter(sizes[s] for _, _, s in rows)
    assert sorted(r["target"] for r in found) == pytest.approx(sorted(want[s] for _, _, s in rows))
    assert all(r["taken"] <= 2 * r["size"] for r in found)


def test_taken_words_come_near_the_target(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 50 as int))").alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"))
    plan = mixing.plan(rows)
    found = mixing.take(rows, plan).groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.first("mix_target").alias("target")).collect()
    assert found and all(abs(r["taken"] - r["target"]) <= 50 for r in found)


def test_plan_refines_only_to_one_hash_value(spark):
    rows = spark.createDataFrame([(None, "a b c", "x"), (None, "a b c", "x"), (1, "a", "y"), (2, "b c d e f", "y")], "doc_id long, text string, source string")
    found = mixing.take(rows, mixing.plan(rows)).collect()
    assert len({r["mix_copies"] for r in found if r["source"] == "x"}) == 1


def test_shards(spark, tmp_path):
    rows = documents()
    found = sharding.op5_sharding(spark, write(tmp_path / "t")).collect()
    assert len(found) == len(rows)
    import zlib

    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    by = {}
    for r in found:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40 and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    shard_of = {}
    for r in found:
        assert shard_of.setdefault(r["doc_id"], r["shard"]) == r["shard"]


def test_shards_are_even_and_growth_moves_one_in_41(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    found = sharding.assign_shards(rows, sharding.tree(40), sharding.tree(41)).cache()
    sizes = [r["count"] for r in found.groupBy("shard").count().collect()]
    assert len(sizes) == 40 and 850 < min(sizes) and max(sizes) < 1150
    moved = found.filter("grown_shard != shard")
    assert 800 < moved.count() < 1160 and {r[0] for r in moved.select("grown_shard").distinct().collect()} == {40}


def test_a_weight_change_moves_only_its_subtree(spark):
    rows = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    heavier = sharding.tree(40, weights={7: 3.0})
    both = sharding.assign_shards(rows, sharding.tree(40), heavier).filter("grown_shard != shard").collect()
    assert any(r["grown_shard"] == 7 for r in both)
    assert {r["grown_shard"] for r in both} <= set(range(10))  # into the region whose weight grew
    assert {r["grown_shard"] for r in both if r["shard"] < 5} <= set(range(5, 10))  # within it, into the rack
    assert {r["grown_shard"] for r in both if 5 <= r["shard"] < 10} <= {7}  # within that, into the shard


def test_write_shards(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(rows, sharding.tree(4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 500
