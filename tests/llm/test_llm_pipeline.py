"""Each stage against a brute-force version on its own input; the first against the operator's own scores."""

from collections import Counter

import corpus_pipeline as c
import pyarrow.parquet as pq
import pytest
from llmcases import LOWEST, benchmark, brute_contained, brute_simhash, words, write
from pyspark.sql import functions as F

from spreadworks.llm import toxicity
from spreadworks.llm.common import materialize, table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def _short_training(monkeypatch):
    """How good the classifier is, test_llm_toxicity.py tests."""
    monkeypatch.setattr(toxicity.train_net, "__defaults__", (2, 0))


def rows_of(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]


def check_stages(spark, path):
    docs = table(spark, path, "documents")
    kept = {}
    for name, stage in c.STAGES:
        kept[name] = before = rows_of(docs)
        columns = docs.columns
        given, docs = docs, materialize(stage(spark, docs, path), name)
        if name != c.STAGES[-1][0]:
            assert docs.columns == columns
        after = rows_of(docs) if name != "sharding" else None
        if name == "toxicity":
            model = toxicity.train(given, table(spark, path, "labels"), ~toxicity.held_out(F.col("doc_id")))
            scores = toxicity.score(given.select("doc_id", "text", "source"), model, name="s").collect()
            assert Counter(after) == Counter((r["doc_id"], r["text"], r["source"]) for r in scores if r["s"] < 0.5)
        elif name == "simhash_near_dedup":
            # a row without an id is a document of its own: its text stands for an id below all others
            texts = sorted({t or "" for d, t, _ in before if d is None})
            own = lambda d, t: LOWEST + 1 + texts.index(t or "") if d is None else d
            component = {d: k for d, _, k in brute_simhash([(own(d, t), t) for d, t, _ in before])}
            want = sorted(min(x for x, k in component.items() if k == c) for c in set(component.values()))
            found = {own(d, t): component[own(d, t)] for d, t, _ in after}
            assert len(after) == len(found) == len(want) and sorted(found.values()) == want and not Counter(after) - Counter(before)
            assert all(d == k for d, k in found.items() if d > LOWEST + len(texts))
        elif name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{path}/benchmark.parquet").to_pylist()]
            gone = {i for i, *_ in brute_contained([(i, r[1]) for i, r in enumerate(before)], items)}
            assert Counter(after) == Counter(r for i, r in enumerate(before) if i not in gone)
        elif name == "mixing_sources":
            assert set(after) <= set(before) and max(Counter(after).values(), default=0) <= 2 * max(Counter(before).values(), default=0)
            total = sum(len(words(t)) for _, t, _ in before)
            longest = max((len(words(t)) for _, t, _ in before), default=0)
            sources = len({s for _, _, s in before})
            assert abs(sum(len(words(t)) for _, t, _ in after) - 1.5 * total) <= sources * longest
        else:
            found = docs.collect()
            assert Counter(r["doc_id"] for r in found) == Counter(d for d, _, _ in before)
            slots = {}
            for r in found:
                slots.setdefault(r["shard"], []).append(r["slot"])
            assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return kept


def test_stages_on_the_smallest_tables(spark):
    check_stages(spark, SMALL)


def test_stages_on_edge_cases(spark, tmp_path):
    kept = check_stages(spark, write(tmp_path / "t"))
    assert len(kept["simhash_near_dedup"]) > len(kept["benchmark_decontamination"]) > len(kept["mixing_sources"]) > 0


def test_unlike_rows_without_an_id_all_stay(spark, tmp_path):
    texts = ["one text about ships and the sea", "quite another text on birds and trees", "numbers one two three four five", None, ""]
    rows = [(None, t, "a") for t in [*texts, texts[0]]] + [(3, texts[1], "b"), (4, "a text of its own with an id", "b"), (4, "a text of its own with an id", "b")]
    path = write(tmp_path / "t", rows)
    found = rows_of(c.near_duplicates_out(spark, table(spark, path, "documents"), path))
    assert Counter((d, t or "") for d, t, _ in found) == Counter([*((None, t) for t in texts[:3]), (None, ""), (4, rows[-1][1])])


def test_clean_rows_beside_a_contaminated_one_of_the_same_id_stay(spark, tmp_path):
    dirty = benchmark()[0][1]
    rows = [(None, dirty, "a"), (None, "a clean text without an id", "a"), (None, None, "a"), (5, "x " + dirty, "b"), (5, "another clean text of five", "b"), (5, "another clean text of five", "b"), (6, dirty, "c"), (7, "clean", "c")]
    path = write(tmp_path / "t", rows)
    assert Counter(rows_of(c.benchmark_out(spark, table(spark, path, "documents"), path))) == Counter(r for r in rows if dirty not in (r[1] or ""))


def test_stages_on_empty_tables(spark, tmp_path):
    assert c.run(spark, write(tmp_path / "t", empty=True)).count() == 0


def test_registered():
    import __spark_entry__ as e

    assert e.queries()["pipeline"] is c.run and [n for n, _ in c.STAGES][0] == "toxicity" and LOWEST < 0
    assert sum(n.startswith("op") and n[2].isdigit() for n in e.queries()) == 13


@pytest.mark.parametrize("name", [n for n, _ in c.STAGES[:-1]])
def test_clashing_names_survive(spark, tmp_path, name):
    path = write(tmp_path / "t")
    docs = table(spark, path, "documents")
    out = dict(c.STAGES)[name](spark, docs, path)
    assert out.columns == docs.columns and out.filter("_n != '1'").isEmpty()
