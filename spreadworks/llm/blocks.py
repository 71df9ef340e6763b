"""Repeated windows over a corpus: blocks at content-defined anchors, comparison, spans.

Shared by the substring operators (13-word windows, 100-byte windows):

0. ``frequent_grams``: which grams a share of the documents (one of 16, by hash of id) has
   very often.  Any answer gives the same result; it keeps anchors from being shared by
   too many blocks.
1. ``cutter``: cut every whole text into blocks (see ``anchors.py``).  Blocks of a
   task's piece of text that share an anchor are compared there by the operator's own
   method (the parse, or the suffix sort).  A block that is a repeat as a whole is
   settled; all others go on, so that a key holds at most one copy for each piece.
2. ``shared``: blocks of one anchor meet, sorted; anchors that occur only once go.
3. the operator compares the contents of what is left (read again by document id), and
4. ``apply_spans`` joins the repeated spans of a document with its text.

Every repeat is found by the operator's comparison, that of whole blocks too.  No step
caps anything.  Anchors with more than ``HOT`` blocks left go another, equally exact
way: their blocks are split into single windows (``windows_of``), whose firsts are a
grouped minimum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import SLOT_BITS, cut, gram_hashes, mix64, slots
from .common import discard, materialize, numbered, small

#: Blocks of one anchor that are compared together; others are split into windows.
HOT = 4096
#: One document of so many is looked at for frequent grams, and how often a gram is frequent there.
DRAWN, FREQUENT = 16, HOT // 64
#: Symbols cut at once (bytes; words: a quarter of it).
PIECE = 1_000_000

OCCURRENCE = "route long, anchor long, doc long, copy int, start int, n int, settled boolean"
SHARED = "settled boolean, anchor long, doc long, copy int, start int, n int, place long"
FETCHED = "anchor long, doc long, copy int, start int, n int, content binary"
WINDOW = "high long, low long, doc long, copy int, start int"
SPAN = "doc long, copy int, start int, n int"

#: (anchor, doc, start, key, windows, content) sorted by anchor, doc and start, to (key, offset, windows) of the repeats.
Compare = Callable[[Iterable[tuple]], Iterator[tuple]]


class Unit:
    """How a text becomes symbols.  strict: only an earlier document counts, not an earlier place in the same one."""

    def __init__(self, words: bool, width: int, gram: int, strict: bool):
        self.words, self.width, self.gram, self.strict = words, width, gram, strict

    def split(self, text: bytes):
        return text.split() if self.words else text

    def symbols(self, parts) -> np.ndarray:
        if self.words:
            return np.array([xxhash.xxh64_intdigest(w) for w in parts], np.uint64)
        return np.frombuffer(parts, np.uint8)

    def content(self, parts, start: int, n: int) -> bytes:
        piece = parts[start : start + n + self.width - 1]
        return b" ".join(piece) if self.words else piece


def texts_of(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).to_pylist() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.to_pylist()


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _rows(ddl: str, arrays) -> pa.RecordBatch:
    schema = _schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(a, type=t) for a, t in zip(arrays, schema.types, strict=True)], schema=schema)


def frequent_grams(rows: DataFrame, unit: Unit, drawn: int = DRAWN, frequent: int = FREQUENT) -> np.ndarray:
    """Mask over the slots of grams found so often in the drawn documents (counted where a piece of text repeats them)."""

    def run(batches):
        for _, _, parts in grouped_texts(batches, unit):
            hashes = [gram_hashes(unit.symbols(p), unit.gram) for p in parts if len(p) >= unit.width]
            if hashes:
                gram, n = np.unique(np.concatenate(hashes), return_counts=True)
                yield _rows("gram long, n long", [gram[n > 1].view(np.int64), n[n > 1]])

    few = rows.filter(F.pmod(F.xxhash64("doc", "copy"), F.lit(drawn)) == 0)
    counts = few.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= frequent)
    found = materialize(counts.select(F.shiftrightunsigned("gram", 64 - SLOT_BITS).alias("slot")).distinct(), "frequent")
    mask = np.zeros(1 << SLOT_BITS, bool)
    for r in found.toLocalIterator():  # at most the table's slots
        mask[r["slot"]] = True
    discard(found)
    return mask


def cutter(unit: Unit, compare: Compare, frequent: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: (doc, copy, text) to OCCURRENCE rows; whole texts, in pieces that overlap by a window."""

    packed = None if frequent is None or not frequent.any() else np.packbits(frequent).tobytes()

    def run(batches):
        mask = None if packed is None else np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for docs, copies, parts in grouped_texts(batches, unit):
            length = np.array([len(p) for p in parts])
            end = np.cumsum(length)
            begin = end - length
            symbols = np.concatenate([unit.symbols(p) for p in parts]) if unit.words else np.frombuffer(b"".join(parts), np.uint8)
            ends = np.repeat(end, length)
            ids, numbers = np.array(docs, np.int64), np.array(copies, np.int32)
            for at in range(0, max(1, len(symbols)), PIECE):
                stop = min(len(symbols), at + PIECE + unit.width - 1)
                start, n, anchor = cut(symbols[at:stop], ends[at:stop] - at, unit.width, unit.gram, mask)
                if len(start):
                    row = np.searchsorted(end, start + at, side="right")
                    yield _local(unit, compare, parts, row, ids[row], numbers[row], start + at - begin[row], n, anchor.view(np.int64))

    return run


def grouped_texts(batches, unit: Unit):
    """Documents in groups of about PIECE symbols."""
    docs, copies, parts, size = [], [], [], 0
    for batch in batches:
        for d, c, t in zip(batch["doc"].to_pylist(), batch["copy"].to_pylist(), texts_of(batch["text"]), strict=True):
            p = unit.split(t)
            docs.append(d)
            copies.append(c)
            parts.append(p)
            size += len(p)
            if size >= (PIECE // 4 if unit.words else PIECE):
                yield docs, copies, parts
                docs, copies, parts, size = [], [], [], 0
    if docs:
        yield docs, copies, parts


def _local(unit: Unit, compare: Compare, parts, row, doc, copy, start, n, anchor) -> pa.RecordBatch:
    """OCCURRENCE rows of one piece: what repeats as a whole within it takes no part in the shuffle by anchor.

    strict: of equal blocks of one document only the first goes on; ``apply_spans`` gives its spans to the others.
    """
    order = np.lexsort((start, copy, doc, anchor))
    row, doc, copy, start, n, anchor = (x[order] for x in (row, doc, copy, start, n, anchor))
    twice = np.zeros(len(anchor), bool)
    twice[1:] = anchor[1:] == anchor[:-1]
    twice[:-1] |= twice[1:]
    keep, found, seen = np.ones(len(anchor), bool), np.zeros(len(anchor), np.int64), set()
    places = np.flatnonzero(twice)

    def blocks():
        last = None
        for i, a, d, r, s, k in zip(places.tolist(), *(x[places].tolist() for x in (anchor, doc, row, start, n)), strict=True):
            content = unit.content(parts[r], s, k)
            if unit.strict:
                if (a, r) != last:
                    last = a, r
                    seen.clear()
                if content in seen:
                    keep[i] = False
                    continue
                seen.add(content)
            yield a, d, s, i, k, content

    for i, _, windows in compare(blocks()):
        found[i] += windows
    settled = found == n
    spread = mix64(doc.view(np.uint64) * np.uint64(31) + start.astype(np.uint64)).view(np.int64)
    return _rows(OCCURRENCE, [x[keep] for x in (np.where(settled, spread, anchor), anchor, doc, copy, start, n, settled)])


def shared(occurrences: DataFrame, strict: bool) -> DataFrame:
    """SHARED rows: the settled ones, and those whose anchor occurs in another document (strict) or at another place.

    place numbers the rows of an anchor.  Rows stream by: of an anchor at most the rows of its first document wait.
    """

    def run(batches):
        waiting, route, count, several = None, None, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch[c].to_numpy(zero_copy_only=False) for c in ("route", "anchor", "doc", "copy", "start", "n", "settled")]
            done = rows[6]
            if done.any():
                yield _rows(SHARED, [done[done], *(x[done] for x in rows[1:6]), np.zeros(done.sum(), np.int64)])
                rows = [x[~done] for x in rows]
                if not len(rows[0]):
                    continue
            if waiting is not None:
                rows = [np.concatenate(x) for x in zip(waiting, rows, strict=True)]
            of, _, doc = rows[:3]
            new = np.append(True, of[1:] != of[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(of)) - 1
            many = doc[first] != doc[last] if strict else last > first
            known = several and of[0] == route
            many[0] |= known
            group = np.cumsum(new) - 1
            place = np.arange(len(of)) - first[group]
            if known:
                place[: last[0] + 1] += count
            out = many[group]
            if out.any():
                yield _rows(SHARED, [x[out] for x in (rows[6], *rows[1:6], place)])
            route, several, count = of[-1], bool(many[-1]), int(place[-1]) + 1
            waiting = None if several else [x[first[-1] :] for x in rows]

    dealt = occurrences.repartition(F.col("route")).sortWithinPartitions("route", "doc", "start", "copy")
    return dealt.mapInArrow(run, SHARED)


def fetched(rows: DataFrame, blocks: DataFrame, unit: Unit) -> DataFrame:
    """FETCHED rows: the contents of blocks, read from their documents."""
    wanted = blocks.groupBy("doc", "copy").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("wanted"))

    def run(batches):
        for batch in batches:
            lists = batch["wanted"]
            flat = lists.flatten()
            counts = np.diff(lists.offsets.to_numpy())
            anchor, start, n = (flat.field(i) for i in range(3))
            starts, ns, at, out = start.to_pylist(), n.to_pylist(), 0, []
            for text, count in zip(texts_of(batch["text"]), counts.tolist(), strict=True):
                parts = unit.split(text)
                out += [unit.content(parts, starts[i], ns[i]) for i in range(at, at + count)]
                at += count
            which = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield _rows(FETCHED, [anchor, batch["doc"].take(which), batch["copy"].take(which), start, n, out])

    return rows.join(wanted, ["doc", "copy"]).select("doc", "copy", "text", "wanted").mapInArrow(run, FETCHED)


def windows_of(blocks: DataFrame, unit: Unit) -> DataFrame:
    """WINDOW rows: each window of the blocks by a 128-bit digest (high, low)."""

    def run(batches):
        for batch in batches:
            high, low, doc, copy, start = [], [], [], [], []
            for d, c, s, n, content in zip(*(batch[x].to_pylist() for x in ("doc", "copy", "start", "n", "content")), strict=True):
                parts = unit.split(content)
                for i in range(n):
                    digest = xxhash.xxh3_128_intdigest(unit.content(parts, i, 1))
                    high.append(digest >> 64)
                    low.append(digest & (2**64 - 1))
                    doc.append(d)
                    copy.append(c)
                    start.append(s + i)
            yield _rows(WINDOW, [np.array(high, np.uint64).view(np.int64), np.array(low, np.uint64).view(np.int64), doc, copy, start])

    return blocks.mapInArrow(run, WINDOW)


def repeated_windows(windows: DataFrame, strict: bool) -> DataFrame:
    """SPAN rows of the windows after their first: a grouped minimum (combined before its shuffle) and a join that AQE may split."""
    first = windows.groupBy("high", "low").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    both = windows.join(first, ["high", "low"])
    later = F.col("doc") > F.col("first.doc")
    if not strict:
        later = later | (F.col("start") > F.col("first.start"))
    return both.filter(later).select("doc", "copy", "start", F.lit(1).alias("n"))


def by_anchor(blocks: DataFrame, compare: Compare) -> DataFrame:
    """SPAN rows that compare finds among the blocks of each anchor (rows sorted by anchor, document, start)."""

    def run(batches):
        def rows():
            for batch in batches:
                anchor, doc, copy, start, n, content = (batch[c].to_pylist() for c in _schema(FETCHED).names)
                yield from zip(anchor, doc, start, zip(doc, copy, start, strict=True), n, content, strict=True)

        out = []
        for (doc, copy, start), offset, n in compare(rows()):
            out.append((doc, copy, start + offset, n))
            if len(out) >= 20_000:
                yield _rows(SPAN, zip(*out, strict=True))
                out = []
        if out:
            yield _rows(SPAN, zip(*out, strict=True))

    return blocks.repartition(F.col("anchor")).sortWithinPartitions("anchor", "doc", "start", "copy").mapInArrow(run, SPAN)


def _equal_windows(unit: Unit, parts, flagged: np.ndarray) -> np.ndarray:
    """flagged windows, and all of the same document that equal one of them."""
    hashes = gram_hashes(unit.symbols(parts), unit.width)
    known = {h: i for h, i in zip(hashes[flagged].tolist(), np.flatnonzero(flagged).tolist(), strict=True)}
    more = np.flatnonzero(np.isin(hashes, hashes[flagged]) & ~flagged)
    w = unit.width
    out = flagged.copy()
    for i, h in zip(more.tolist(), hashes[more].tolist(), strict=True):
        out[i] = parts[i : i + w] == parts[known[h] : known[h] + w]
    return out


def apply_spans(rows: DataFrame, spans: DataFrame, unit: Unit) -> DataFrame:
    """Per document row: doc, units long, spans array of (start, end) in units (maximal), kept binary."""
    lists = spans.groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "n")).alias("found"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            units, removed, kept = [], [], []
            lists = batch["found"]
            for text, found in zip(texts_of(batch["text"]), lists, strict=True):
                parts = unit.split(text)
                units.append(len(parts))
                if not found.is_valid:
                    removed.append([])
                    kept.append(b" ".join(parts) if unit.words else text)
                    continue
                start, n = (found.values.field(i).to_numpy() for i in range(2))
                step = np.zeros(len(parts) + 1, np.int32)
                if unit.strict:
                    np.add.at(step, start, 1)
                    np.add.at(step, start + n, -1)
                    start = np.flatnonzero(_equal_windows(unit, parts, np.cumsum(step[: len(parts) - unit.width + 1]) > 0))
                    step[:], n = 0, 1
                np.add.at(step, start, 1)
                np.add.at(step, start + n + unit.width - 1, -1)
                gone = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                removed.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                if unit.words:
                    kept.append(b" ".join(p for p, g in zip(parts, gone.tolist(), strict=True) if not g))
                else:
                    kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(units, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=["doc", "units", "spans", "kept"])

    joined = rows.join(lists, ["doc", "copy"], "left").select("doc", "text", "found")
    return joined.mapInArrow(run, "doc long, units long, spans array<struct<start: long, end: long>>, kept binary")


def remove_repeats(docs: DataFrame, unit: Unit, compare: Compare, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The four steps; see the module's text.  The result's columns are those of apply_spans."""
    rows = numbered(docs, id_col, text_col)
    cut_up = cutter(unit, compare, frequent_grams(rows, unit))
    found = materialize(shared(rows.mapInArrow(cut_up, OCCURRENCE), unit.strict), "shared")
    open_, written = found.filter("not settled"), [found]
    hot = materialize(open_.filter(F.col("place") == HOT).select("anchor").distinct(), "hot")
    total = found.filter("settled").select("doc", "copy", "start", "n")
    written.append(hot)
    if hot.isEmpty():
        total = total.unionByName(by_anchor(fetched(rows, open_, unit), compare))
    else:
        few = small(hot)
        total = total.unionByName(by_anchor(fetched(rows, open_.join(few, "anchor", "left_anti"), unit), compare))
        windows = materialize(windows_of(fetched(rows, open_.join(few, "anchor", "left_semi"), unit), unit), "windows")
        written.append(windows)
        total = total.unionByName(repeated_windows(windows, unit.strict))
    spans = materialize(total, "spans")
    discard(*written)
    return apply_spans(rows, spans, unit)
