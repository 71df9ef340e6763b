"""Line dedup: lines that many documents share go, but for one document.

A line's key is the line without white space at both ends, A-Z lower-cased.  A key of
at least 40 code points found in at least 5 documents loses all its lines except those
of the largest document id that holds it.

1. Every task keeps the hashes of its lines' keys (once for each document) and turns
   them into bits of two Bloom filters: seen once, and seen twice (in two documents of
   the task).  Filters are cut into slices; a slice's parts meet in one task, which adds
   a bit to the twice-seen filter when a second part brings it.
2. The twice-seen filter, of at most ``MAX_BITS`` bits, travels to the tasks.  Only lines
   that it knows are suspected and written; a line of one document is almost never.
3. Suspects are counted by the whole key (combined before the shuffle), which confirms
   them exactly and chooses the largest document; only confirmed keys meet the suspects
   again (by SHA-256), and only places to drop go back to the documents.

A filter never misses a repeat, so its size decides how much is shuffled and nothing
else: past some 10^8 lines of distinct text it fills and more lines become suspects.

Defined results: a null or empty text is one empty line.  Each row is a document; of rows
that share the largest id all keep their lines; a null id is smaller than all others
and stays null in the result.  Keys' ties do not exist: a key has one largest id.  Lines
are compared and texts are read whole, however long.  Empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, numbered, prepare, public_id, table

#: Code points of a key, and documents that must hold it.
LEAST, DOCUMENTS = 40, 5
#: Bits of a filter: one for each 8 bytes of text, between these bounds (64 MiB at most).
MIN_BITS, MAX_BITS = 1 << 16, 1 << 29
#: Bits set by a key; bits of a slice; hashes a task holds before it turns them into bits.
PROBES, SLICE, HELD = 3, 1 << 22, 1 << 20


def key_of(line: bytes) -> bytes | None:
    """The key of a line (UTF-8), or None if it is too short."""
    key = line.strip().lower()
    if len(key) < LEAST or (len(key) < 4 * LEAST and not key.isascii() and len(key.decode()) < LEAST):
        return None
    return key


def keys_of(text: str) -> dict[bytes, int]:
    """Distinct keys of a text and the number of the first line of each."""
    found: dict[bytes, int] = {}
    for i, line in enumerate(text.encode().split(b"\n")):
        if len(line) >= LEAST and (key := key_of(line)) is not None:
            found.setdefault(key, i)
    return found


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers of each hash, one row for each probe."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(hashes + np.uint64(i) * (step + np.uint64(i))) & np.uint64(bits - 1) for i in range(PROBES)])


FILTER = "slice int, once binary, twice binary"


def filter_parts(bits: int):
    """mapInArrow function: texts to FILTER rows, the bits of a task's lines as ascending places within a slice."""

    def parts(held: list[np.ndarray]) -> pa.RecordBatch:
        hashes, times = np.unique(np.concatenate(held), return_counts=True)
        width = min(bits, SLICE)
        cuts = np.arange(0, bits + 1, width, dtype=np.uint64)
        once, twice = (np.unique(probes(h, bits)) for h in (hashes, hashes[times > 1]))
        at, both = np.searchsorted(once, cuts), np.searchsorted(twice, cuts)
        out = [(k, (once[at[k] : at[k + 1]] - cuts[k]).astype(np.uint32).tobytes(), (twice[both[k] : both[k + 1]] - cuts[k]).astype(np.uint32).tobytes()) for k in range(len(cuts) - 1) if at[k] < at[k + 1]]
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["slice", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch["text"].to_pylist():
                hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys_of(text)], np.uint64)
                if len(hashes):
                    held.append(hashes)
                    size += len(hashes)
                if size >= HELD:
                    yield parts(held)
                    held, size = [], 0
        if held:
            yield parts(held)

    return run


def twice_seen(rows: DataFrame, bits: int) -> bytes:
    """The filter of hashes seen in two documents: bits / 8 bytes, MAX_BITS / 8 at most."""
    width = min(bits, SLICE)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one, two = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.packbits(two).tobytes()], pa.binary())], names=["slice", "bits"])

        for batch in batches:
            for k, once, twice in zip(*(batch[c].to_pylist() for c in ("slice", "once", "twice")), strict=True):
                if k != last:
                    if last is not None:
                        yield done()
                    last, one, two = k, np.zeros(width, bool), np.zeros(width, bool)
                places = np.frombuffer(once, np.uint32)
                two[places[one[places]]] = True
                one[places] = True
                two[np.frombuffer(twice, np.uint32)] = True
        if last is not None:
            yield done()

    dealt = rows.select("text").mapInArrow(filter_parts(bits), FILTER).repartition("slice").sortWithinPartitions("slice")
    slices = materialize(dealt.mapInArrow(merge, "slice int, bits binary"), "twice")
    out = bytearray(bits // 8)
    for r in slices.toLocalIterator():
        out[r["slice"] * width // 8 : (r["slice"] + 1) * width // 8] = r["bits"]
    discard(slices)
    return bytes(out)


SUSPECT = "doc long, copy int, line int, key string"


def suspects(rows: DataFrame, bits: int, twice: bytes) -> DataFrame:
    """SUSPECT rows: the keys (once for each document, with the number of their first line) that the filter knows."""
    sent = rows.sparkSession.sparkContext.broadcast(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            which, lines, keys = [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                found = keys_of(text)
                which += [i] * len(found)
                lines += found.values()
                keys += found
            if not keys:
                continue
            at = probes(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64), bits)
            hit = np.flatnonzero(((known[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1).all(axis=0))
            of = pa.array(np.array(which)[hit])
            keys = pa.array([keys[i] for i in hit.tolist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc"].take(of), batch["copy"].take(of), pa.array(np.array(lines, np.int32)[hit]), keys], names=["doc", "copy", "line", "key"])

    return rows.mapInArrow(run, SUSPECT)


def confirmed(found: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(key, top): keys that so many documents hold, and the largest id; counted before and after the shuffle."""
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.max("doc").alias("top")).filter(F.col("times") >= documents).select("key", "top")


RESULT = "doc long, lines long, dropped array<int>, kept string"


def line_dedup(docs: DataFrame, documents: int = DOCUMENTS, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT rows, one for each document: its number of lines, the numbers of those dropped, and the text that stays."""
    prepare(docs.sparkSession)
    rows = numbered(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max_bits, max(MIN_BITS, 1 << (size // 8).bit_length()))
    found = materialize(suspects(rows, bits, twice_seen(rows, bits)), "suspects")
    keys = materialize(confirmed(found, documents), "confirmed")
    digest = F.unhex(F.sha2("key", 256)).alias("digest")
    both = found.select("doc", "copy", "line", digest).join(keys.select(digest, "top").hint("merge"), "digest").filter("doc != top")
    drops = materialize(both.groupBy("doc", "copy").agg(F.collect_list("line").alias("first")), "drops")
    discard(found, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, dropped, kept = [], [], []
            for text, first in zip(batch["text"].to_pylist(), batch["first"].to_pylist(), strict=True):
                lines, gone = text.split("\n"), []
                if first:
                    raw = [x.encode() for x in lines]
                    keys = {key_of(raw[i]) for i in first}
                    gone = [i for i, x in enumerate(raw) if len(x) >= LEAST and key_of(x) in keys]
                    out = set(gone)
                    text = "\n".join(x for i, x in enumerate(lines) if i not in out)
                counts.append(len(lines))
                dropped.append(gone)
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(counts, pa.int64()), pa.array(dropped, pa.list_(pa.int32())), pa.array(kept, pa.string())], names=["doc", "lines", "dropped", "kept"])

    return rows.join(drops.hint("merge"), ["doc", "copy"], "left").select("doc", "text", "first").mapInArrow(run, RESULT)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select(public_id().alias("doc_id"), F.col("lines").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES = {
    "op11_line_dedup": r"""
WITH l AS (SELECT r, doc_id, i, x[i] AS line,
                  translate(regexp_replace(x[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
           FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
                unnest(range(1, len(x) + 1)) AS t(i)),
k AS (SELECT key, max(coalesce(doc_id, -9223372036854775808)) AS top FROM l WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT r) >= 5),
d AS (SELECT r, doc_id, i, line, top IS NOT NULL AND coalesce(doc_id, -9223372036854775808) <> top AS gone FROM l LEFT JOIN k USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY r
""",
}
