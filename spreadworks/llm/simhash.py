"""SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits; two documents link if theirs differ in at most three.  Of
two such fingerprints, one half of the bits differs in at most one place.  On 31 bits
of each half the perfect Hamming code serves as covering code: every word lies within
distance 1 (the covering radius) of exactly one codeword, its home.  Each fingerprint
is replicated to every codeword (anchor) within radius + threshold = 2, which is 16
anchors a half.  If x and y differ in at most one bit of the half, y is replicated to
the home of x, so comparing the homes of an anchor with its visitors finds every link.

Copies share one fingerprint, which is compared once.  An anchor's links are reduced to
one per fingerprint (to the least of its local component) before they leave the task,
and components then grow by alternating large-star and small-star steps, each written
to the shared folder.

Defined results: a null or empty text has fingerprint zero, linked like any other; a
null id counts as the smallest; rows that share an id are one document; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import texts_of
from .common import LOWEST, discard, materialize, prepare, public_id, table

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Rows of an anchor beyond which its comparisons are split by bytes of the other half (exact all the same).
WIDE = 20_000
#: Shingles whose bits are counted at once.
PIECE = 100_000


def bit_counts(hashes: list[int]) -> np.ndarray:
    """How many hashes have each of the 64 bits, most significant first."""
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes) -> int:
    """The signed 64-bit fingerprint of a text: a bit is 1 if over half of the shingle hashes have it."""
    words = text.lower().split()  # bytes: lowers A-Z only, splits at ASCII white space only
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return int(np.array([digest(b" ".join(words), SEED)], np.uint64).view(np.int64)[0]) if words else 0
    n = len(words) - SHINGLE + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        stop = min(n, at + PIECE)
        counts += bit_counts([digest(b" ".join(t), SEED) for t in zip(words[at:stop], words[at + 1 : stop + 1], words[at + 2 : stop + 2], strict=True)])
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc long, fp long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for t in texts_of(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(found, pa.int64())], names=["doc", "fp"])

    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LOWEST)).alias("doc"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, "doc long, fp long")


# positions 1 to 31 of a half; a word's syndrome is the xor of the positions that are set
_PLACES = np.arange(1, 32, dtype=np.uint64)
#: The pairs {i, i ^ s} (i < i ^ s, both nonzero) for each syndrome s, as masks of two bits.
_PAIRS = np.zeros((32, 15), np.uint64)
for _s in range(1, 32):
    _PAIRS[_s] = [(1 << (i - 1)) | (1 << ((i ^ _s) - 1)) for i in range(1, 32) if i < i ^ _s and i != _s]


def anchors_of(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home, visited) codewords of 31-bit words: one home each, 15 more at distance 2 (none, if the word is a codeword)."""
    syndrome = np.zeros(len(half), np.uint64)
    for p in _PLACES:
        syndrome ^= ((half >> (p - np.uint64(1))) & np.uint64(1)) * p
    flip = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1)), np.uint64(0))
    return half ^ flip, np.where(syndrome[:, None] > 0, half[:, None] ^ _PAIRS[syndrome.astype(int)], half[:, None])


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch["fp"].to_numpy().view(np.uint64)
        node = batch["node"].to_numpy()
        for side in (0, 1):
            half = (fp >> np.uint64(32 * side)) & np.uint64(0x7FFFFFFF)
            home, visited = anchors_of(half)
            base = np.uint64(side) << np.uint64(32)
            moved = visited[:, 0] != half  # a codeword has no other anchor within distance 2
            anchor = np.concatenate([home, visited[moved].ravel()]) | base
            rows = np.concatenate([np.arange(len(fp)), np.repeat(np.flatnonzero(moved), 15)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(np.arange(len(rows)) < len(fp)), pa.array(fp[rows].view(np.int64)), pa.array(node[rows])],
                names=["anchor", "home", "fp", "node"],
            )


def _least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least member of each element's component, for links a-b among 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _links(fp: np.ndarray, home: np.ndarray, side: int, split: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Links between homes and all rows of one anchor, at most two per row: found home by home, kept as a forest."""
    n = len(fp)
    if split and n > WIDE:
        a, b = [], []
        other = (fp >> np.uint64(32 * (1 - side))) & np.uint64(0xFFFFFFFF)
        for k in range(4):  # at most three bits differ: one of the other half's four bytes is equal
            byte = (other >> np.uint64(8 * k)) & np.uint64(0xFF)
            by = np.argsort(byte, kind="stable")
            for rows in np.split(by, np.flatnonzero(np.diff(byte[by])) + 1):
                x, y = _links(fp[rows], home[rows], side, False)
                a.append(rows[x])
                b.append(rows[y])
        return np.concatenate(a), np.concatenate(b)
    label = np.arange(n)
    for h in np.flatnonzero(home):
        near = np.bitwise_count(fp ^ fp[h]) <= DISTANCE
        met = np.unique(label[near])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _compare(anchor, home, fp, node) -> pa.RecordBatch:
    """Links of whole anchors (rows sorted by anchor) as (node, least node of its local component)."""
    new = np.append(True, anchor[1:] != anchor[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(anchor)))
    homes = np.add.reduceat(home.astype(np.int64), begin)
    a, b = [], []
    small = np.flatnonzero((homes > 0) & (size > 1) & (size <= 64))
    if len(small):  # all (home, row) pairs of the small anchors at once
        group = np.repeat(small, size[small])
        rows = np.arange(len(group)) - np.repeat(np.cumsum(size[small]) - size[small], size[small]) + begin[group]
        h = rows[home[rows]]
        g = group[home[rows]]
        left = np.repeat(h, size[g])
        right = np.arange(len(left)) - np.repeat(np.cumsum(size[g]) - size[g], size[g]) + np.repeat(begin[g], size[g])
        near = (np.bitwise_count(fp[left] ^ fp[right]) <= DISTANCE) & (left != right)
        a.append(left[near])
        b.append(right[near])
    for g in np.flatnonzero((homes > 0) & (size > 64)).tolist():
        at = slice(begin[g], begin[g] + size[g])
        x, y = _links(fp[at], home[at], int(anchor[begin[g]] >> 32))
        a.append(x + begin[g])
        b.append(y + begin[g])
    if not a or not sum(map(len, a)):
        x = y = np.zeros(0, np.int64)
    else:
        label = _least_labels(np.concatenate(a), np.concatenate(b), len(anchor))
        least = np.full(len(anchor), np.iinfo(np.int64).max)
        np.minimum.at(least, label, node)
        x, y = node, least[label]
        x, y = x[x != y], y[x != y]
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch[c].to_numpy(zero_copy_only=False) for c in ("anchor", "home", "fp", "node")]
        rows[2] = rows[2].view(np.uint64)
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        cutoff = int(np.searchsorted(rows[0], rows[0][-1]))
        held = [x[cutoff:] for x in rows]
        if cutoff:
            yield _compare(*(x[:cutoff] for x in rows))
    if held is not None:
        yield _compare(*held)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) with a > b: links that connect what lies within three bits; nodes: (fp, node), fp distinct."""
    replicas = nodes.mapInArrow(_replicas, "anchor long, home boolean, fp long, node long")
    return replicas.repartition(F.col("anchor")).sortWithinPartitions("anchor").mapInArrow(_compared, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): b is the least node that a (> b) reaches; alternating large-star and small-star steps."""
    edges = materialize(edges, "links")

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = state(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, old = materialize(large, "large-star"), edges
        discard(old)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = materialize(small, "small-star")
        discard(large)
        before, now = now, state(edges)
        if before == now:
            break
    return edges


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, fp, component) of every row: component is the smallest id that links reach, a document's own included."""
    prepare(docs.sparkSession)
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    pairs = prints.groupBy("fp").agg(F.min("doc").alias("node"))
    # rows that share an id but not a fingerprint are one document: they link
    shared = prints.groupBy("doc").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x != y").select("doc")
    same = prints.join(shared, "doc").join(pairs, "fp").filter("doc != node").select(F.col("doc").alias("a"), F.col("node").alias("b"))
    nodes = materialize(pairs, "nodes")
    roots = components(links(nodes).unionByName(same).distinct())
    named = nodes.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    named = named.select("fp", F.coalesce("root", "node").alias("component"))
    return prints.join(named, "fp").select("doc", "fp", "component")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(
        public_id().alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        public_id("component").alias("component_id"),
    )
