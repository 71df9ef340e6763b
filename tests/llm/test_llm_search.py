import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from llmcases import LOWEST, benchmark, brute_contained, documents, write
from oracle import assert_same

from spreadworks.llm import decontaminate, license_scan, topk
from spreadworks.llm.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_contained_items_equal_brute_force(spark, tmp_path):
    rows = [(d, t) for d, t, _ in documents()]
    found = decontaminate.op3_benchmark_decontamination(spark, write(tmp_path / "t"))
    assert {tuple(r[c] for c in ("doc_id", "item_id", "n_shingles", "n_shared", "containment")) for r in found.collect()} == brute_contained(rows, benchmark())


@pytest.mark.parametrize("broadcast_rows", [decontaminate.BROADCAST_ROWS, 0])
def test_contained_items_equal_sql(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast_rows)
    assert_same(spark, QUERIES["op3_benchmark_decontamination"], ORACLES["op3_benchmark_decontamination"], SMALL)


def test_contained_items_at_the_threshold(spark):
    """Items with 10 shingles, of which a text holds 7, 8 or 9: only 8 and more count."""
    item = [f"i{k}" for k in range(14)]
    texts = [(k, " ".join(["before"] * 50 + item[: k + 4] + ["after"] * 50)) for k in (7, 8, 9, 10)]
    found = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {r["doc"]: r["containment"] for r in found.collect()} == {8: 0.8, 9: 0.9, 10: 1.0}


def test_decontamination_main_path_has_no_python(spark):
    plan = decontaminate.op3_benchmark_decontamination(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def brute_licenses(rows, threshold=0.8):
    found = {}
    for d, t in rows:
        w = license_scan.words_of((t or "").encode())
        for k, (name, template) in enumerate(license_scan.TEMPLATES):
            want = license_scan.words_of(template.encode())
            want = {tuple(want[i : i + 5]) for i in range(len(want) - 4)}
            s = 1 << (len(want) - 1).bit_length()
            for at in range(0, max(1, len(w) - 4), s):
                here = w[at : at + 2 * s + 4]
                share = len(want & {tuple(here[i : i + 5]) for i in range(len(here) - 4)}) / len(want)
                if share >= threshold:
                    key = (d, k, name)
                    found[key] = max(found.get(key, (0, 0)), (share, -at))
    return {(None if d == LOWEST else d, k, name, share, -at) for (d, k, name), (share, at) in found.items()}


def test_licenses_equal_brute_force(spark, tmp_path):
    g = random.Random(9)
    rows = documents()
    for i, (_, template) in enumerate(license_scan.TEMPLATES):
        noise = " ".join(g.choice(["a1", "b2", "c3"]) for _ in range(g.randrange(200)))
        words = template.split()
        rows += [(300 + i, f"{noise} {template} {noise}", "a"), (400 + i, f"{noise} {template.upper()} {noise} {template}", "a"), (500 + i, noise + " " + " ".join(words[: len(words) // 2]), "a"), (600 + i, " ".join(words[1:] + ["end"]), "a")]
    found = license_scan.op2_license_scan(spark, write(tmp_path / "t", rows))
    brute = brute_licenses([(LOWEST if d is None else d, t) for d, t, _ in rows])
    assert {tuple(r[c] for c in ("doc_id", "template", "license", "containment", "start_word")) for r in found.collect()} == brute
    assert {300 + i for i in range(12)} <= {b[0] for b in brute}


def test_licenses_on_the_smallest_tables(spark):
    t = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    found = license_scan.op2_license_scan(spark, SMALL)
    assert {tuple(r[c] for c in ("doc_id", "template", "license", "containment", "start_word")) for r in found.collect()} == brute_licenses([(r["doc_id"], r["text"]) for r in t])


def test_full_texts_from_a_table(spark):
    """A license of several hundred words, from a table, amid other text; also with every tenth word changed at its end."""
    g = random.Random(3)
    text = " ".join(g.choice("the software is provided as it stands without any kind of warranty to whoever uses copies or changes it".split()) + str(g.randrange(9)) for _ in range(400))
    table = spark.createDataFrame([("long", text), ("long", text), ("none", None), ("short", "too short")], "license string, text string")
    templates = license_scan.templates_of(table)
    assert templates == [("long", text)]
    words = text.split()
    docs = [(1, "before " * 300 + text + " after" * 200), (2, " ".join(words[:390])), (3, " ".join(words[:200])), (4, "before " * 77 + text.upper())]
    found = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), templates).collect()
    assert {r["doc"] for r in found} == {1, 2, 4} and all(r["containment"] >= 0.8 for r in found)
    with pytest.raises(ValueError, match="more than"):
        license_scan.templates_of(table, most_bytes=10)


def test_short_templates_are_refused():
    with pytest.raises(ValueError, match="5 words"):
        license_scan.Index([("x", "too short")])


def test_top_k_equals_sql(spark):
    assert_same(spark, QUERIES["op6_exact_top_k"], ORACLES["op6_exact_top_k"], SMALL)


def vectors(path, rows):
    path.mkdir()
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "dim": pa.array(["1"] * len(rows), pa.string()), "shard": pa.array(["1"] * len(rows), pa.string()), "v": pa.array(["1"] * len(rows), pa.string())}), path / "embeddings.parquet")
    return str(path)


def brute_top(rows, k=10):
    good = [(LOWEST if i is None else i, [int(np.floor(np.float64(np.float32(c)) * 1024)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    asks = {}
    for i, v in good:
        if i % 100 == 0 and i != LOWEST:
            asks[i] = min(asks.get(i, (len(v), v)), (len(v), v))
    out = []
    for q, (_, v) in asks.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, r + 1, None if i == LOWEST else i, -s) for r, (s, i) in enumerate(scored[:k])]
    return Counter(out)


@pytest.mark.parametrize(("shard_rows", "leaf"), [(topk.SHARD_ROWS, topk.LEAF_ROWS), (64, 8)])
def test_top_k_edges_equal_brute_force(spark, tmp_path, monkeypatch, shard_rows, leaf):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk.BallTree.__init__, "__defaults__", (leaf,))
    g = np.random.default_rng(4)
    rows = [(i, g.normal(size=6).round(1).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # a hot vector, ties
    rows += [(2000, None), (2100, []), (2101, []), (2200, [1.0, None, 1, 1, 1, 1]), (2300, [float("nan")] * 6), (2400, [float("inf")] * 6), (None, [9.0] * 6), (300, [5.0] * 6), (7, [5.0] * 6), (7, [5.0] * 6), (2500, [1.0, 2.0]), (-100, [1.0] * 6)]
    found = topk.op6_exact_top_k(spark, vectors(tmp_path / "t", rows))
    assert Counter(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in found.collect()) == brute_top(rows)


def test_top_k_of_huge_components_is_exact(spark, tmp_path):
    rows = [(i * 50, [1e5 + i, -3e4 * i, 7.0]) for i in range(30)]
    found = topk.op6_exact_top_k(spark, vectors(tmp_path / "t", rows))
    assert Counter(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in found.collect()) == brute_top(rows)


@pytest.mark.parametrize("name", ["op2_license_scan", "op3_benchmark_decontamination"])
def test_empty_tables(spark, tmp_path, name):
    assert QUERIES[name](spark, write(tmp_path / "t", empty=True)).count() == 0


def test_no_vectors(spark, tmp_path):
    assert topk.op6_exact_top_k(spark, vectors(tmp_path / "t", [])).count() == 0
    assert topk.op6_exact_top_k(spark, vectors(tmp_path / "u", [(100, [1.0])])).count() == 0
