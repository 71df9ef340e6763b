"""Suffix-array dedup of bytes: two-stage sorting, then adjacent common prefixes.

Content-defined anchors (``blocks.py``) bring together the byte blocks that can share a
100-byte string; a task lays the blocks of whole anchors end to end and sorts their
suffixes.  Stage one directly sorts only suffixes that are smaller than their
successors; stage two induces all others by one scan over the buckets of the first
symbol.  Of suffixes that start no 100-byte string of their block, only those take part
that an induced one rests on.  Neighbours in the order whose common prefix reaches 100
bytes hold the same string; all but the earliest (document, start) of such a run are
repeats.  Within a task's piece of text the same sort settles what repeats as a whole
there, before anything is shuffled.

Defined results: a null text is empty; a null id counts as the smallest; rows that
share an id count as one document, places compared by start; equal rows get equal
results; texts under 100 bytes are kept whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Unit, remove_repeats
from .common import prepare, public_id, table

WIDTH = 100
UNIT = Unit(words=False, width=WIDTH, gram=20, strict=False)
#: Bytes of blocks that are sorted at once (whole anchors: at most this plus one anchor).
BIN = 700_000


class Packed:
    """The symbols (under 256) as one string, whose slices compare as the suffixes do."""

    def __init__(self, symbols: np.ndarray):
        plain = symbols.astype(np.uint8)
        self.text = plain.tobytes().decode("latin-1")
        #: The first eight symbols from each place, as numbers.
        self.heads = np.ndarray(len(plain), np.dtype(">u8"), np.append(plain, np.zeros(7, np.uint8)), 0, (1,))

    def order(self, at: np.ndarray, depth: int) -> np.ndarray:
        """The places of at, sorted by the depth symbols from each: by eight of them first, which leaves little to compare."""
        text = self.text
        at = at[np.argsort(self.heads[at].astype(np.uint64), kind="stable")]
        keys = [text[i : i + depth] for i in at.tolist()]
        return at[sorted(range(len(keys)), key=keys.__getitem__)]


def suffix_order(symbols: np.ndarray, packed: Packed, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The wanted suffixes (a mask; None: all), sorted by their first depth symbols, in two stages."""
    n = len(symbols)
    places = np.arange(n, dtype=np.int32)
    # a suffix is smaller than its successor if the first unequal symbol to its right is larger; the last one is not
    unequal = np.append(symbols[1:] != symbols[:-1], True)
    known = np.minimum.accumulate(np.where(unequal, places, n)[::-1])[::-1]
    smaller = np.append(symbols[1:] > symbols[:-1], False)[known]
    needed = np.ones(n, bool)
    if wanted is not None:  # an induced suffix rests on all that follow it, up to the next directly sorted one
        until = np.minimum.accumulate(np.where(smaller, places, n)[::-1])[::-1]
        needed = wanted | (np.maximum.accumulate(np.where(wanted & ~smaller, until, -1)) >= places)
    direct = packed.order(np.flatnonzero(smaller & needed), depth)
    takes = needed & ~smaller
    first = symbols[direct]
    alphabet = np.flatnonzero(np.bincount(symbols, minlength=1))
    cuts = np.searchsorted(first, alphabet), np.searchsorted(first, alphabet, side="right")
    induced: dict[int, list[np.ndarray]] = {int(c): [] for c in alphabet}
    if takes[n - 1]:
        induced[int(symbols[-1])].append(np.array([n - 1]))

    def scan(places: np.ndarray) -> None:
        before = places[places > 0] - 1
        before = before[takes[before]]
        if len(before):
            c = symbols[before]
            if len(before) > 1:
                by = np.argsort(c, kind="stable")
                before, c = before[by], c[by]
            edge = (np.flatnonzero(c[1:] != c[:-1]) + 1).tolist()
            for x, y in zip([0, *edge], [*edge, len(c)], strict=True):
                induced[int(c[x])].append(before[x:y])

    out = []
    for c, lo, hi in zip(alphabet.tolist(), *(x.tolist() for x in cuts), strict=True):
        at = 0
        while at < len(induced[c]):  # a scan can add to its own bucket: runs of one symbol
            scan(induced[c][at])
            at += 1
        out += induced[c]
        scan(direct[lo:hi])
        out.append(direct[lo:hi])
    order = np.concatenate(out)
    return order if wanted is None else order[wanted[order]]


def common_prefixes(symbols: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in the order, counted up to most."""
    step = -(-most // 8)
    padded = np.concatenate([symbols.astype(np.uint8), np.zeros(8 * step, np.uint8)])
    words = np.ndarray((len(symbols), step), np.dtype("<u8"), padded, 0, (1, 8))  # the words from each place
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 50_000):
        stop = min(len(order), at + 50_000)
        unequal = words[order[at - 1 : stop - 1]] ^ words[order[at:stop]]
        word = (unequal != 0).argmax(axis=1)
        bits = unequal[np.arange(stop - at), word]
        out[at:stop] = np.where(bits == 0, most, 8 * word + (np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)) >> 3))
    return np.minimum(out, most)


def repeats(rows: list[tuple]) -> Iterator[tuple]:
    """(key, offset, windows): the runs of windows of whole anchors whose string starts earlier in one of the blocks."""
    texts = [r[5] for r in rows]
    length = np.array([len(t) for t in texts])
    doc, start, n = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 4))
    begin = np.cumsum(length + 1) - length - 1
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    block = np.repeat(np.arange(len(rows), dtype=np.int32), length + 1)
    offset = np.arange(len(symbols), dtype=np.int32) - begin[block].astype(np.int32)
    order = suffix_order(symbols, Packed(symbols), WIDTH, offset < n[block])
    new = common_prefixes(symbols, order, WIDTH) < WIDTH
    heads = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    d, s = doc[block[order]], start[block[order]] + offset[order]
    least_d = np.minimum.reduceat(d, heads)[run]
    least_s = np.minimum.reduceat(np.where(d == least_d, s, np.iinfo(np.int64).max), heads)[run]
    later = np.zeros(len(symbols), bool)
    later[order] = (d > least_d) | (s > least_s)
    edge = np.flatnonzero(np.diff(later.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
    for b, at, k in zip(block[edge[:, 0]].tolist(), offset[edge[:, 0]].tolist(), (edge[:, 1] - edge[:, 0]).tolist(), strict=True):
        yield rows[b][3], at, k


def sorted_blocks(rows: Iterable[tuple]) -> Iterator[tuple]:
    """The same for rows that stream by, in bins of whole anchors; an anchor with one block has nothing to compare."""
    held: list[tuple] = []
    size = alone = 0
    for row in rows:
        if held and row[0] != held[-1][0]:
            if alone == len(held) - 1:
                size -= len(held.pop()[5]) + 1
            alone = len(held)
            if size >= BIN:
                yield from repeats(held)
                held, size, alone = [], 0, 0
        held.append(row)
        size += len(row[5]) + 1
    if held:
        yield from repeats(held)


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc, units (bytes), spans array of byte ranges removed, kept (binary)."""
    prepare(docs.sparkSession)
    return remove_repeats(docs, UNIT, sorted_blocks, id_col, text_col)


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    found = suffix_array_dedup(table(spark, sf_dir, "documents"))
    return found.select(
        public_id().alias("doc_id"),
        F.col("units").alias("n_bytes"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
