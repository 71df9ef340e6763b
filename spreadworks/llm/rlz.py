"""Substring dedup of words by Relative Lempel-Ziv parsing against indexed reference blocks.

A document is factored greedily against text of documents with smaller ids: the factor
at a place is the longest match that any indexed reference block offers.  A factor of
at least 13 words is a duplicate span; at a factor's end the parse steps back to the
first window that straddles the boundary, because another reference block may hold
that window.  Content-defined anchors (``blocks.py``) bring each document block together
with all reference blocks that can match it, so the index of a task is bounded and the
parse still runs against every reference block of the corpus.  Within a task's piece of
text the same parse settles what repeats as a whole there, before anything is shuffled.

Defined results: a null text has no words; a null id counts as the smallest; rows that
share an id are one document to the rule (they never remove each other's words); a text
of fewer than 13 words is kept; equal rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Unit, remove_repeats
from .common import prepare, public_id, table

WIDTH = 13
UNIT = Unit(words=True, width=WIDTH, gram=5, strict=True)


def factor_spans(words: list[bytes], index: dict, width: int) -> list[tuple[int, int]]:
    """Greedy factors of at least width words as (first window, windows), boundaries checked.

    index: the width words of a reference window, joined, to (reference words, place).
    """
    found, at, last = [], 0, len(words) - width
    while at <= last:
        hit = index.get(b" ".join(words[at : at + width]))
        if hit is None:
            at += 1
            continue
        reference, place = hit
        end, r = at + width, place + width
        while end < len(words) and r < len(reference) and words[end] == reference[r]:
            end, r = end + 1, r + 1
        found.append((at, end - width + 1 - at))
        at = end - width + 1  # the first window across the factor's boundary
    return found


def parse_blocks(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(key, first window, windows) of the factors: each block against the blocks of documents with smaller ids.

    rows: (anchor, doc, start, key, windows, content), sorted.  They stream by; the index holds the distinct
    reference windows of one anchor.
    """
    for _, group in groupby(rows, key=itemgetter(0)):
        index: dict = {}
        for _, blocks in groupby(group, key=itemgetter(1)):
            parsed: dict[bytes, tuple] = {}  # a document may repeat a block; it is parsed once
            for _, _, _, key, _, content in blocks:
                if content not in parsed:
                    words = content.split(b" ")
                    parsed[content] = words, factor_spans(words, index, WIDTH) if index else []
                for first, windows in parsed[content][1]:
                    yield key, first, windows
            for words, found in parsed.values():
                n = len(words) - WIDTH + 1
                if sum(k for _, k in found) < n:  # else the index has them all
                    for i in range(n):
                        index.setdefault(b" ".join(words[i : i + WIDTH]), (words, i))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc, units (words), spans array of word ranges removed, kept (binary, words joined by a space)."""
    prepare(docs.sparkSession)
    return remove_repeats(docs, UNIT, parse_blocks, id_col, text_col)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select(
        public_id().alias("doc_id"),
        F.col("units").alias("n_words"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLES = {
    "op4_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS gram
      FROM w, unnest(range(1, len(words) - 11)) AS t(i)),
f AS (SELECT gram, min(doc_id) AS first_doc FROM g GROUP BY gram HAVING min(doc_id) < max(doc_id)),
d AS (SELECT DISTINCT g.doc_id, g.i + o.j AS p FROM g JOIN f USING (gram), unnest(range(0, 13)) AS o(j)
      WHERE f.first_doc < g.doc_id),
l AS (SELECT doc_id, list(p) AS gone FROM d GROUP BY doc_id),
k AS (SELECT w.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
             list_filter(list_zip(words, range(1, len(words) + 1)),
                         lambda x: NOT list_contains(coalesce(gone, []::BIGINT[]), x[2])) AS kept
      FROM w LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_transform(kept, lambda x: x[1]), ' '), '')) AS kept_sha256
FROM k
""",
}
