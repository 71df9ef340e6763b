"""Line dedup, cross-tokenizer alignment, phrase collocations."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from llmcases import LOWEST, documents, write
from oracle import assert_same
from pyspark.sql import functions as F

from spreadworks.llm import collocations, line_dedup, token_align
from spreadworks.llm.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
NAMES = ["op11_line_dedup", "op12_cross_tokenizer_alignment", "op13_phrase_collocations"]


@pytest.mark.parametrize("name", ["op11_line_dedup", "op13_phrase_collocations"])
def test_same_as_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name], SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, tmp_path, name):
    assert QUERIES[name](spark, write(tmp_path / "t", empty=True)).count() == 0


def put(path, rows):
    """documents of (doc_id, text, lang) with columns whose names clash."""
    path.mkdir(parents=True, exist_ok=True)
    clash = {c: pa.array(["1"] * len(rows), pa.string()) for c in "doc copy line key first top slice bits word gram times part id piece bucket pairs score phrase".split()}
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string())} | clash), path / "documents.parquet")
    return str(path)


# lines

COMMON = "This line of at least forty code points stands in many texts"


def lined():
    g = random.Random(3)
    own = lambda: " ".join(g.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(12))
    out = [(None, None), (None, COMMON), (1, ""), (2, "\n\n"), (3, COMMON + "\r\n" + COMMON.upper() + "\n" + own())]
    out += [(10 + i, "\n".join([own(), " \t" + COMMON + "\x0b", own(), "short line", COMMON])) for i in range(6)]
    out += [(20 + i, "é" * (39 + i % 2)) for i in range(12)] + [(40 + i, "É" * 40) for i in range(4)] + [(41, "É" * 40), (41, "É" * 40)]
    out += [(60 + i, "\xa0" + "x" * 39 + "\n" + "y" * 39 + " \n" + "z" * 40 + "\x1c") for i in range(5)]
    out += [(80 + i, "four documents hold this line, which is one too few") for i in range(4)] + [(90, "\n".join(["one document repeats this line again and again"] * 50))]
    out += [(100, "\n".join(own() for _ in range(3000)) + "\n" + COMMON), (101, "w" * 300_000), (101, "w" * 300_000)]
    return out


def brute_lines(rows):
    key = lambda x: re.sub(r"^[ \t-\r]+|[ \t-\r]+\Z", "", x).translate({c: c + 32 for c in range(65, 91)})
    texts = [(LOWEST if d is None else d, (t or "").split("\n")) for d, t in rows]
    holds = defaultdict(list)
    for d, lines in texts:
        for k in {key(x) for x in lines if len(key(x)) >= 40}:
            holds[k].append(d)
    out = Counter()
    for d, lines in texts:
        kept = [x for x in lines if len(holds.get(key(x), ())) < 5 or max(holds[key(x)]) == d]
        out[(None if d == LOWEST else d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("max_bits", [line_dedup.MAX_BITS, 64])
def test_lines_against_brute_force(spark, tmp_path, max_bits):
    """A filter that is full, of 64 bits, suspects every line and changes nothing."""
    path = put(tmp_path / "t", [(d, t, None) for d, t in lined()])
    docs = spark.read.parquet(f"{path}/documents.parquet").repartition(5)
    found = line_dedup.line_dedup(docs, max_bits=max_bits)
    found = found.select("doc", "lines", F.size("dropped"), F.sha2(F.col("kept").cast("binary"), 256)).collect()
    assert Counter((None if r[0] == LOWEST else r[0], *r[1:]) for r in found) == brute_lines(lined())
    assert_same(spark, QUERIES["op11_line_dedup"], ORACLES["op11_line_dedup"], path)


def test_few_lines_of_one_document_are_suspected(spark):
    """The filter keeps lines of one document out of the shuffle, and misses no other."""
    docs = spark.range(4000).select(F.col("id").alias("doc"), F.lit(0).alias("copy"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit("\n"), F.when(F.col("id") % 4 == 0, F.lit(COMMON)).otherwise("")).alias("text")).repartition(7)
    bits = 1 << 18
    found = line_dedup.suspects(docs, bits, line_dedup.twice_seen(docs, bits)).groupBy((F.col("key") == COMMON.lower()).alias("common")).count().collect()
    counts = {r["common"]: r["count"] for r in found}
    assert counts[True] == 1000 and counts.get(False, 0) < 80


# tokens

def brute_alignment(texts):
    """Per text the contract's columns, with sets of links and no array arithmetic."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(token_align.FILES[0]), sentencepiece.SentencePieceProcessor(model_file=token_align.FILES[1])
    a_model.encode_special_tokens = True
    stand = token_align.byte_of()
    rows, held = [], Counter()
    for text in texts:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(stand[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes.fromhex(p[3:5]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b_model.id_to_piece, b)]
        if not text or not (b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode()):
            a, b, a_bytes, b_bytes = [], [], [], []
        ends = [list(itertools.accumulate(map(len, x))) for x in (a_bytes, b_bytes)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([i for i, e in zip(a, ends[0], strict=True) if low < e <= high], [i for i, e in zip(b, ends[1], strict=True) if low < e <= high]) for low, high in zip([0, *cuts], cuts, strict=False)]
        pairs = Counter(p for x, y in groups for p in itertools.product(x, y))
        held.update(pairs.keys())
        rows.append((len(a), len(b), groups, pairs))
    top = defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    for n_a, n_b, groups, pairs in rows:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield n_a, n_b, len(groups), pairs.total(), sum(n for p, n in pairs.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in pairs.items()), hashlib.sha256(shown.encode()).hexdigest() if groups else ""


def spoken():
    g = random.Random(7)
    marks = ["<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "▁", "▁a", "\x00", "​", "𝔘", "日本語", "naïve", "\xa0", "\t", "\r\n", "  ", "\n", "\n ", "don't", "I'LL", "123456", "…", "—", "é", "ﬁ", "🙂🙂", "\x85", "\x1c", "٣٤", "Straße,"]
    out = [t for _, t, *_ in documents()] + marks + ["a" + m + "b" for m in marks] + [m + " " + m for m in marks]
    out += [" ".join(g.choice(marks + ["word", "other", "Thing"]) for _ in range(30)) for _ in range(30)]
    out += [" lead", "trail ", " ", "two  spaces", "x" * 3000, "ab" * 2000 + " tail", "é" * 500, "🙂" * 300, " ".join("word" for _ in range(2000))]
    return out


@pytest.mark.parametrize("piece", [token_align.PIECE, 2000])
def test_alignment_against_brute_force(spark, tmp_path, piece):
    """Pieces of some texts each give what one piece gives."""
    rows = [(None if i % 9 == 0 else i // 2, t, None) for i, t in enumerate(spoken())]
    path = put(tmp_path / "t", rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    found = token_align.align(docs, piece=piece, step=min(piece, 1000)).collect()
    want = Counter((d, *x) for (d, *_), x in zip(rows, brute_alignment([r[1] for r in rows]), strict=True))
    assert Counter(map(tuple, found)) == want


def test_alignment_of_given_texts(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = token_align.op12_cross_tokenizer_alignment(spark, SMALL).drop("doc_id").collect()
    assert Counter(map(tuple, found)) == Counter(brute_alignment(texts))


def test_long_groups_are_linked_alike(monkeypatch):
    """A group that is linked by its distinct ids, some of them at a time, gives what expansion gives."""
    import numpy as np

    g = np.random.default_rng(1)
    a, b = g.integers(0, 50, 400), g.integers(0, 40, 300)
    group_a, group_b = np.sort(g.integers(0, 4, 400)), np.sort(g.integers(0, 4, 300))
    doc = np.array([0, 0, 1, 2])
    want = token_align.links(a, b, group_a, group_b, doc, 100)
    for most in (5000, 64):
        monkeypatch.setattr(token_align, "LINKS", most)
        found = token_align.links(a, b, group_a, group_b, doc, 100)
        assert all((x == y).all() for x, y in zip(want, found, strict=True))


# phrases

def phrases():
    g = random.Random(9)
    vocabulary = "of the in a to and new york city bank rate of".split()
    out = [(None, None, None), (1, "", "en"), (2, " .,;:!?\n\x0b\x0c\r", "en")]
    out += [(i, " ".join(g.choice(vocabulary) + g.choice(["", "", "", ",", ".", "\n", "\t", "  "]) for _ in range(g.randint(1, 60))), g.choice(["en", "en", None, "und", "de"])) for i in range(3, 120)]
    out += [(200, "New York City " * 400, "en"), (201, "ÉCOLE élan\xa0mot " * 50, "fr"), (202, "a-b a\x01 a " * 60, "fr"), (202, "a-b a\x01 a " * 60, "fr"), (203, "same " * 5000, "xx"), (204, "rare words once", "yy")]
    out += [(300 + i, f"fixed phrase here{'.' if i % 5 else ' extra'} tail{i}", "de") for i in range(90)]
    return out


def brute_phrases(rows, top=2000):
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            for n in range(1, 5):
                counts["und" if lang is None else lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= 30}
        rows = []
        for p, a in candidates.items():
            if any(100 * c >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in candidates.items() if len(q) > len(p)):
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((score, a, " ".join(p), left, right))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        yield from ((lang, i + 1, p, a, left, right, n, score) for i, (score, a, p, left, right) in enumerate(rows[:top]))


def test_phrases_against_brute_force(spark, tmp_path):
    path = put(tmp_path / "t", phrases())
    found = QUERIES["op13_phrase_collocations"](spark, path).collect()
    assert sorted(map(tuple, found)) == sorted(brute_phrases(phrases()))
    assert_same(spark, QUERIES["op13_phrase_collocations"], ORACLES["op13_phrase_collocations"], path)


@pytest.mark.parametrize("few", [0, 10**6])
def test_phrases_in_many_ranges_and_with_a_large_dictionary(spark, tmp_path, monkeypatch, few):
    """Ranges of some hundred keys, and words that meet the texts by a shuffle, change nothing."""
    monkeypatch.setattr(collocations, "GROUP", 1000)
    docs = spark.read.parquet(put(tmp_path / "t", phrases()) + "/documents.parquet").repartition(6)
    found = collocations.mine(docs, few=few, per_range=300, held=500).select("lang", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, found)) == sorted((lang, *rest) for lang, _, *rest in brute_phrases(phrases(), 10**9))


def test_counts_that_pass_64_bits(spark):
    """The score's product is exact where a count of phrases is."""
    big = 9 * 10**12 + 7
    frame = spark.createDataFrame([(big, big + 5, 2 * big)], "a long, l long, r long")
    score = frame.selectExpr(f"(cast(a as decimal(20, 0)) * {collocations.SCALE}) div (cast(l as decimal(20, 0)) + r) as s").first()[0]
    assert score == big * 2_000_000 // (big + 5 + 2 * big)
