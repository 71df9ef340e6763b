"""Tables of edge cases, and brute-force versions in plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import xxhash

LOWEST = -(2**63)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Columns whose names operators use for themselves.
CLASHING = "doc copy anchor block start n found fp node component score shard slot bucket size h w k c hits need test hash item rows _gone _key _html _n _place _toxicity mix_size mix_source mix_copies mix_p_limit prefix words key".split()


def sentence(g, n, vocabulary="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()):
    return " ".join(g.choice(vocabulary) for _ in range(n))


def documents():
    """(doc_id, text, source): nulls, empty, white space only, short, repeats, ties, near copies, one very long text."""
    g = random.Random(5)
    base = [sentence(g, 40) for _ in range(8)]
    shared = sentence(g, 30)
    out = [(None, None, None), (None, base[0], "a"), (1, None, "a"), (2, "", "b"), (3, " \t\n\x0b\x0c\r ", None), (4, "one", "b"), (5, "one two three four", "b"), (6, "one", "c")]
    out += [(10 + i, t, "abc"[i % 3]) for i, t in enumerate(base)]
    out += [(20 + i, base[i] + " tail", "hot") for i in range(4)] + [(30 + i, base[0], "hot") for i in range(30)]
    out += [(70 + i, sentence(g, 25) + " " + shared + " " + sentence(g, 20), "hot") for i in range(5)]
    out += [(80, base[3].upper(), "a"), (81, base[3].replace(" ", " "), "a"), (82, base[4].replace(" ", "\n\t "), "a"), (83, "Ä" + base[5] + " \x1c \x85 ß", "é")]
    out += [(90, base[1], "a"), (90, base[1], "a"), (90, base[2], "b"), (-7, base[2], "")]
    out += [(100, sentence(g, 3000) + " " + "same " * 1500 + shared, "long"), (101, "x" * 5000, "long"), (102, "ab" * 400 + "ba" * 300, "long"), (103, "same " * 700, "long")]
    out += [(200 + i, " ".join(g.choice("pq") for _ in range(60)), "two") for i in range(12)]
    return out


def benchmark():
    d = documents()
    return [(1, d[8][1]), (2, " ".join(d[9][1].split()[:20])), (3, "one two three four"), (4, None), (5, ""), (None, " ".join(d[10][1].split()[5:30])), (6, d[8][1]), (6, "other words that no text has in it"), (7, "one"), (8, " ".join(d[11][1].split()[:18]) + " x y")]


def write(path: Path, rows=None, empty=False) -> str:
    """The llm tables under path; empty: without rows."""
    path.mkdir(parents=True, exist_ok=True)
    rows = [] if empty else documents() if rows is None else rows
    extra = {c: pa.array(["1"] * len(rows), pa.string()) for c in CLASHING}
    table = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([None] * len(rows), pa.string()), "source": pa.array([r[2] for r in rows], pa.string()), "n_chars": pa.array([None] * len(rows), pa.int64())}
    pq.write_table(pa.table(table | extra), path / "documents.parquet")
    items = [] if empty else benchmark()
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string()), "w": pa.array(["1"] * len(items), pa.string()), "n": pa.array([1] * len(items), pa.int64())}), path / "benchmark.parquet")
    marks = [] if empty else [(d, None if d == 11 else 0, int(d is not None and 70 <= d < 80)) for d, *_ in rows if d != 13] + [(10, 1, None), (9999, 0, 1)]
    pq.write_table(pa.table({"doc_id": pa.array([m[0] for m in marks], pa.int64()), "quality": pa.array([m[1] for m in marks], pa.int32()), "toxic": pa.array([m[2] for m in marks], pa.int32())}), path / "labels.parquet")
    return str(path)


def words(text):
    return WORD.findall((text or "").encode())


def lowered(text):
    return (text or "").encode().lower()


def repeats(rows, units, width, strict):
    """(doc, removed places, n units, n spans) per row: units covered by a window that also starts earlier."""
    first = {}
    for doc, text in rows:
        u = units(text)
        for i in range(len(u) - width + 1):
            key = tuple(u[i : i + width]) if isinstance(u, list) else u[i : i + width]
            place = (doc, 0 if strict else i)
            first[key] = min(first.get(key, place), place)
    for doc, text in rows:
        u = units(text)
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            key = tuple(u[i : i + width]) if isinstance(u, list) else u[i : i + width]
            if first[key] < (doc, 0 if strict else i):
                gone[i : i + width] = [True] * width
        yield doc, u, gone


def brute_words(rows):
    rows = [(LOWEST if d is None else d, t) for d, t in rows]
    for doc, u, gone in repeats(rows, words, 13, True):
        kept = b" ".join(w for w, x in zip(u, gone, strict=True) if not x)
        yield None if doc == LOWEST else doc, len(u), sum(gone), hashlib.sha256(kept).hexdigest()


def brute_bytes(rows):
    rows = [(LOWEST if d is None else d, t) for d, t in rows]
    for doc, u, gone in repeats(rows, lambda t: (t or "").encode(), 100, False):
        kept = bytes(b for b, x in zip(u, gone, strict=True) if not x)
        yield None if doc == LOWEST else doc, len(u), sum(gone), sum(1 for k, _ in itertools.groupby(gone) if k), hashlib.sha256(kept).hexdigest()


def fingerprint(text):
    w = WORD.findall(lowered(text))
    if not w:
        return 0
    n = max(1, len(w) - 2)
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > n)


def brute_simhash(rows):
    """Multiset of (doc, fingerprint, component)."""
    rows = [(LOWEST if d is None else d, fingerprint(t)) for d, t in rows]
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            up[f] = up[up[f]]
            f = up[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            up[root(a)] = root(b)
    own = {}
    for d, f in rows:
        if d in own:
            up[root(f)] = root(own[d])
        own[d] = f
    least = {}
    for d, f in rows:
        least[root(f)] = min(d, least.get(root(f), d))
    shown = lambda d: None if d == LOWEST else d
    return Counter((shown(d), f"{f:016x}", shown(least[root(f)])) for d, f in rows)


def shingles(text, n=5):
    """Distinct word shingles as the decontamination defines them."""
    w = [x for x in re.split("[ \t-\r]+", (text or "").lower()) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_contained(rows, items, threshold=0.8):
    found = {}
    for d, t in rows:
        has = shingles(t)
        for i, text in items:
            test = shingles(text)
            if test and len(test & has) / len(test) >= threshold:
                best = (len(test & has) / len(test), len(test), len(test & has))
                found[d, i] = max(found.get((d, i), best), best)
    return {(d, i, n, k, c) for (d, i), (c, n, k) in found.items()}

