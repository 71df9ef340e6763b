import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from llmcases import brute_bytes, brute_simhash, brute_words, documents, write
from oracle import assert_same
from pyspark.sql import functions as F

from spreadworks.llm import blocks, rlz, simhash, suffix_dedup
from spreadworks.llm.anchors import cut
from spreadworks.llm.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def got(df, *names):
    return Counter(tuple(r[c] for c in names) for r in df.collect())


def small_rows():
    t = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"]) for r in t]


def test_substring_dedup_equals_brute_force(spark, tmp_path):
    rows = [(d, t) for d, t, _ in documents()]
    found = rlz.op4_substring_dedup(spark, write(tmp_path / "t"))
    assert got(found, "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute_words(rows))


def test_substring_dedup_equals_sql(spark):
    assert_same(spark, QUERIES["op4_substring_dedup"], ORACLES["op4_substring_dedup"], SMALL)


def test_suffix_dedup_equals_brute_force(spark, tmp_path):
    rows = [(d, t) for d, t, _ in documents()]
    found = suffix_dedup.op7_suffix_array_dedup(spark, write(tmp_path / "t"))
    assert got(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute_bytes(rows))


def test_suffix_dedup_on_the_smallest_tables(spark):
    found = suffix_dedup.op7_suffix_array_dedup(spark, SMALL)
    assert got(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute_bytes(small_rows()))


@pytest.mark.parametrize("op", ["op4", "op7"])
def test_anchors_with_very_many_blocks_go_the_exact_other_way(spark, tmp_path, monkeypatch, op):
    monkeypatch.setattr(blocks, "HOT", 2)
    g = random.Random(3)
    core = " ".join(f"w{i}" for i in range(7)) + " " + "c" * 50
    rows = [(i, " ".join(g.choice(["l", "m", "n"]) for _ in range(9)) + " " + core + " " + " ".join(g.choice(["r", "s"]) * 9 for _ in range(9)), "a") for i in range(60)]
    path = write(tmp_path / "t", rows)
    plain = [(d, t) for d, t, _ in rows]
    if op == "op4":
        assert got(rlz.op4_substring_dedup(spark, path), "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute_words(plain))
    else:
        assert got(suffix_dedup.op7_suffix_array_dedup(spark, path), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute_bytes(plain))


def test_suffix_order_sorts_every_suffix():
    g = np.random.default_rng(1)
    for n, k in ((1, 2), (50, 1), (300, 2), (700, 4)):
        symbols = np.append(g.integers(1, k + 1, n), 0).astype(np.uint16)
        order = suffix_dedup.suffix_order(symbols, suffix_dedup.Packed(symbols), len(symbols))
        assert order.tolist() == sorted(range(n + 1), key=lambda i: symbols[i:].tolist())


def test_factors_are_greedy_and_boundaries_are_checked():
    index = {}
    for text in (b"a b c d e", b"d e f g"):
        w = text.split()
        for i in range(len(w) - 2):
            index.setdefault(b" ".join(w[i : i + 3]), (w, i))
    assert rlz.factor_spans(b"x a b c d e f g y".split(), index, 3) == [(1, 3), (4, 2)]


def test_cut_covers_every_window_once():
    g = np.random.default_rng(2)
    symbols = g.integers(0, 3, 5000).astype(np.uint8)
    ends = np.repeat([1200, 1250, 5000], [1200, 50, 3750])
    start, n, _ = cut(symbols, ends, 100, 20)
    windows = np.concatenate([np.arange(s, s + k) for s, k in zip(start, n, strict=True)])
    assert windows.tolist() == [i for i in range(4901) if i + 100 <= ends[i]]


def test_simhash_equals_brute_force(spark, tmp_path):
    rows = [(d, t) for d, t, _ in documents()]
    found = simhash.op10_simhash_near_dedup(spark, write(tmp_path / "t"))
    assert got(found, "doc_id", "fingerprint", "component_id") == brute_simhash(rows)


def test_simhash_on_the_smallest_tables(spark):
    assert got(simhash.op10_simhash_near_dedup(spark, SMALL), "doc_id", "fingerprint", "component_id") == brute_simhash(small_rows())


@pytest.mark.parametrize("wide", [simhash.WIDE, 8])
def test_links_lose_no_pair(spark, monkeypatch, wide):
    """Planted fingerprints at distance 0 to 5 of a few centres, chains among them; also with large anchors split."""
    monkeypatch.setattr(simhash, "WIDE", wide)
    g = np.random.default_rng(7)
    centres = [int(x) for x in g.integers(0, 2**63, 40)] + [0, 2**64 - 1]
    fps = set(centres)
    for c in centres:
        for _ in range(8):
            fps.add(c ^ sum(1 << int(b) for b in g.choice(64, int(g.integers(1, 6)), replace=False)))
    fps.update(centres[0] ^ (1 << i) for i in range(64))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    found = {r["a"]: r["b"] for r in simhash.components(simhash.links(nodes)).collect()}
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert {i: found.get(i, i) for i in range(len(fps))} == {i: root(i) for i in range(len(fps))}


@pytest.mark.parametrize("name", ["op4_substring_dedup", "op7_suffix_array_dedup", "op10_simhash_near_dedup"])
def test_empty_tables(spark, tmp_path, name):
    assert QUERIES[name](spark, write(tmp_path / "t", empty=True)).count() == 0


def largest_route(spark, module, rows):
    docs = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string")
    found = blocks.numbered(docs).mapInArrow(blocks.cutter(module.UNIT, module.parse_blocks if module is rlz else module.sorted_blocks), blocks.OCCURRENCE)
    return found.groupBy("route").count().agg({"count": "max"}).first()[0] or 0


def fullest(spark, module, docs, frequent):
    method = module.parse_blocks if module is rlz else module.sorted_blocks
    found = docs.mapInArrow(blocks.cutter(module.UNIT, method, frequent), blocks.OCCURRENCE)
    return found.groupBy("route").count().agg({"count": "max"}).first()[0]


@pytest.mark.parametrize("module", [rlz, suffix_dedup])
def test_one_passage_of_many_documents_loads_no_route(spark, module):
    """20,000 documents of random words share 60 words: what stands around these is not dealt out by them."""
    passage = F.lit(" ".join(f"shared{i}" for i in range(60)))
    random_words = lambda k: F.expr(f"array_join(transform(sequence(1, 30), i -> conv(pmod(xxhash64(id, i, {k}), 5000), 10, 36)), ' ')")
    docs = spark.range(0, 20_000, 1, 4).select(F.col("id").alias("doc"), F.lit(0).alias("copy"), F.concat_ws(" ", random_words(1), passage, random_words(2)).alias("text"))
    frequent = blocks.frequent_grams(docs, module.UNIT)
    assert frequent.any() and fullest(spark, module, docs, frequent) < blocks.HOT // 4 < 10_000 < fullest(spark, module, docs, None)


@pytest.mark.parametrize("module", [rlz, suffix_dedup])
def test_frequent_grams_change_nothing(spark, monkeypatch, module):
    """Whatever is taken for frequent, up to everything, the same repeats are found."""
    g = random.Random(4)
    passage = " ".join(f"shared{i}" for i in range(20))
    rows = [(i, " ".join([*(g.choice("abcdefgh") for _ in range(20)), passage, *(g.choice("ab") for _ in range(30))])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    operator = rlz.substring_dedup if module is rlz else suffix_dedup.suffix_array_dedup
    want = sorted(map(str, operator(docs).collect()))
    for every in (1, 2, 3):
        mask = np.arange(1 << blocks.SLOT_BITS) % every == 0
        monkeypatch.setattr(blocks, "frequent_grams", lambda rows, unit, mask=mask: mask)
        assert sorted(map(str, operator(docs).collect())) == want


@pytest.mark.parametrize("module", [rlz, suffix_dedup])
def test_one_repetitive_text_loads_no_route(spark, module):
    """A text of 200,000 equal words and one whose line comes 20,000 times send few blocks to any one anchor."""
    line = "one line that comes again and again in this text of many lines without end or change. "
    assert largest_route(spark, module, [(1, "same " * 200_000)]) <= 8
    assert largest_route(spark, module, [(2, line * 20_000)]) <= 8


def test_repeats_of_a_repetitive_document_are_found(spark, tmp_path):
    line = "one line that comes again and again in this text of many lines without end or change "
    rows = [(1, "x " + line * 3), (2, line * 200 + "unlike " + line), (3, "same " * 500), (4, "other " + "same " * 40 + "end " + line), (5, "same " * 13), (6, "same " * 12)]
    path = write(tmp_path / "t", [(d, t, "a") for d, t in rows])
    assert got(rlz.op4_substring_dedup(spark, path), "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute_words(rows))
    assert got(suffix_dedup.op7_suffix_array_dedup(spark, path), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute_bytes(rows))


def test_whole_blocks_are_found_by_the_method(spark, tmp_path, monkeypatch):
    """Copies of whole texts: without the operator's comparison nothing is found."""
    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    none = blocks.remove_repeats(docs, rlz.UNIT, lambda rows: (x for x in list(rows)[:0]))
    assert none.filter("size(spans) > 0").isEmpty()
    assert rlz.substring_dedup(docs).filter("size(spans) = 1").count() == 39


def test_common_prefixes_are_lengths():
    g = np.random.default_rng(4)
    symbols = g.integers(0, 2, 400).astype(np.uint8)
    order = suffix_dedup.suffix_order(symbols, suffix_dedup.Packed(symbols), 400)
    got_lengths = suffix_dedup.common_prefixes(symbols, order, 20)
    text = symbols.tobytes()
    for k in range(1, len(order)):
        a, b = text[order[k - 1] :], text[order[k] :]
        want = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert min(want, 20) == got_lengths[k] or min(len(a), len(b)) < 20


def test_suffix_order_of_wanted_suffixes():
    g = np.random.default_rng(6)
    for n, k in ((50, 2), (600, 3)):
        symbols = np.append(g.integers(1, k + 1, n), 0).astype(np.uint16)
        wanted = g.random(n + 1) < 0.3
        order = suffix_dedup.suffix_order(symbols, suffix_dedup.Packed(symbols), n + 1, wanted)
        assert order.tolist() == [i for i in sorted(range(n + 1), key=lambda i: symbols[i:].tolist()) if wanted[i]]
