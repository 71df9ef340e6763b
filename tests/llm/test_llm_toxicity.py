import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from llmcases import documents, write
from pyspark.sql import functions as F

from spreadworks.llm import toxicity

DENSE = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_held_out_accuracy(spark):
    found = {r["doc_id"]: r for r in toxicity.op8_toxicity(spark, DENSE).toLocalIterator()}
    documents_ = pq.read_table(f"{DENSE}/documents.parquet", columns=["doc_id"]).num_rows
    assert len(found) == documents_
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for d, r in found.items())
    labels = [(r["doc_id"], r["toxic"]) for r in pq.read_table(f"{DENSE}/labels.parquet").to_pylist()]
    out = [(found[d]["score"], t) for d, t in labels if d in found and found[d]["held_out"]]
    score, label = np.array([s for s, _ in out]), np.array([t == 1 for _, t in out])
    assert auc(score, label) > 0.93
    assert ((score >= 0.5) == label).mean() > 0.95


def test_edges_and_extra_columns(spark, tmp_path):
    path = write(tmp_path / "t")
    found = toxicity.op8_toxicity(spark, path)
    assert found.count() == len(documents()) and found.filter("score IS NULL OR isnan(score)").isEmpty()
    model = toxicity.Model(None, None, 0.25)
    docs = spark.createDataFrame([(1, "a", "x"), (None, None, None)], "doc_id long, text string, other string")
    assert [r["s"] for r in toxicity.score(docs, model, name="s").collect()] == [0.25, 0.25]


def test_without_labels_of_both_kinds(spark, tmp_path):
    path = write(tmp_path / "t", empty=True)
    assert toxicity.op8_toxicity(spark, path).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    assert model.net is None and model.base == 1.0


def test_windows_cover_whole_texts():
    for n in (0, 1, 63, 64, 65, 96, 97, 1000):
        starts = toxicity.window_starts(n)
        covered = {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n)) and starts == sorted(set(starts))


def test_gradients_match_finite_differences():
    net = toxicity.Net(3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    words = [b"some", b"words", b"here", b"badword"]
    parts = toxicity.Parts(words)
    ids = np.full((2, toxicity.WINDOW), -1)
    ids[0, :5], ids[1, :3] = [0, 1, 2, 3, 1], [3, 3, 0]
    kept = {}
    x = net.inputs(parts)
    gates = np.concatenate([x @ net.p["x"] + net.p["b"], np.zeros((1, 6 * toxicity.HIDDEN))])
    net.forward(gates, ids, kept)
    grad, d_gates = net.backward(np.array([1.0, 0.0]), kept, len(words))
    for k in ("hf", "hb", "a", "v", "o"):
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        value, out = net.p[k][at], []
        for step in (0.01, -0.01):  # the states are single precision: small steps drown
            net.p[k][at] = value + step
            out.append(net.forward(gates, ids)[0])
        net.p[k][at] = value
        assert grad[k][at] == pytest.approx((out[0] - out[1]) / 0.02, rel=0.02)
    at = np.unravel_index(np.abs(d_gates).argmax(), d_gates.shape)
    up, down = gates.copy(), gates.copy()
    up[at] += 0.01
    down[at] -= 0.01
    assert d_gates[at] == pytest.approx((net.forward(up, ids)[0] - net.forward(down, ids)[0]) / 0.02, rel=0.02)


def test_the_scorer_equals_the_network():
    net = toxicity.Net(4)
    g = np.random.default_rng(1)
    words = [f"w{i}".encode() for i in range(50)]
    texts = [b" ".join(words[j] for j in g.integers(0, 50, n)) for n in (0, 3, 64, 200)]
    found = toxicity.Scorer(net).features(texts)
    number = {w: i for i, w in enumerate(words)}
    parts = toxicity.Parts(words)
    for text, row in zip(texts, found, strict=True):
        rows = np.array([number[w] for w in text.split()], np.int64)
        logit = toxicity._logits(net, parts, toxicity.padded(rows, toxicity.window_starts(len(rows))))
        assert row[0] == pytest.approx(logit.max(), abs=1e-4) and row[3] == pytest.approx(np.log(len(logit)))


def test_long_words_are_read_to_their_end():
    for word in ("x" * 5000, "漢字" * 999, "😀" * 61, "a_b-c/" * 50, "-" * 400, "a" * 300 + "...", "word\u00a0and\u3000more" * 9, "ที่นี่" * 20, "ok_😀_f*ck_" * 20):
        found = toxicity.tokens(word.encode())
        assert toxicity.tokens(b" ".join(found)) == found and max(map(len, found)) <= toxicity.LONGEST
        assert set(re.sub(r"[-_/.\s]", "", word)) <= set(b"".join(found).decode())
    text = "".join(map(chr, range(0x4E00, 0x4E00 + 333)))  # all characters differ: every 7 in a row lie in one piece
    found = [p.decode() for p in toxicity.tokens(text.encode())]
    assert all(any(text[i : i + 7] in p for p in found) for i in range(327))
    assert toxicity.tokens(b"Short words" + b"." * 99) == [b"short", b"words" + b"." * 99]
    one, other = (toxicity.Parts([b"a" * 100 + end]) for end in (b"bad", b"fine"))
    assert set(one.flat.tolist()) != set(other.flat.tolist())


@pytest.mark.parametrize("sign", ["_", "-", "/", "\u00a0", "", "cjk"])
def test_a_toxic_phrase_at_the_end_of_a_long_token_counts(sign):
    g = np.random.default_rng(2)
    cjk = sign == "cjk"
    plain = ["".join(chr(0x4E00 + k) for k in g.integers(0, 60, 3)) if cjk else "".join("abcdefgh"[k] for k in g.integers(0, 8, 5)) for _ in range(80)]
    bad, sign = ("侮辱罵倒" if cjk else "vilezwurm"), "" if cjk else sign

    def text(toxic, joined, n=40):
        words = [plain[k] for k in g.integers(0, len(plain), n)]
        return joined.join([*words, bad] if toxic else words)

    toxic = np.arange(120) % 2 == 0
    net = toxicity.train_net([toxicity.tokens(text(t, sign if cjk else " ").encode()) for t in toxic], toxic, 5, 100)
    clean = [text(False, sign) for _ in range(10)]
    logit = toxicity.Scorer(net).features([t.encode() for c in clean for t in (c, c + sign + bad)])[:, 0].reshape(-1, 2)
    assert (logit[:, 1] > logit[:, 0] + 1).all()


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "word " * (2000 if i == 3 else 20)) for i in range(40)] + [(5, "another text"), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(99, 1)], "doc_id long, toxic int")
    got, toxic, every = toxicity.sample(docs, labels, F.lit(True), 10, 6, 1000)
    assert (toxic, every) == (21, 41) and len({r["doc_id"] for r in got}) == len(got) <= 16
    for kind, most in ((1, 10), (0, 6)):
        texts = [r["text"] for r in got if r["toxic"] == kind]
        assert 0 < len(texts) <= most and sum(map(len, texts)) <= 1000
    whole, _, _ = toxicity.sample(docs, labels, F.lit(True))
    assert len(whole) == 40 and {r["doc_id"]: r["text"] for r in whole}[5] == "another text" and max(len(r["text"]) for r in whole) == 10_000


def test_recall_of_toxic_texts_on_rows_not_learned_from(spark):
    """Folds of the learnable rows, never the held-out ones: settings may be compared here."""
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{DENSE}/labels.parquet").to_pylist() if r["toxic"] is not None}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in pq.read_table(f"{DENSE}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    rows = [d for d in sorted(labels) if d in texts and zlib.crc32(str(d).encode()) % 5]
    test = [d for d in rows if zlib.crc32(b"fold%d" % d) % 4 == 0]
    learn = [d for d in rows if zlib.crc32(b"fold%d" % d) % 4]
    toxic = np.array([labels[d] > 0 for d in learn])
    model = toxicity.fitted(learn, [toxicity.tokens(texts[d]) for d in learn], toxic, (~toxic).sum() / toxic.sum())
    score = model.scores(toxicity.Scorer(model.net), [texts[d] for d in test])
    mark = np.array([labels[d] > 0 for d in test])
    assert (score[mark] >= 0.5).mean() >= 0.9 and (score[~mark] >= 0.5).mean() <= 0.03
