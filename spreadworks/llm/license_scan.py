"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Words are runs of ASCII letters and digits, lower-cased; shingles have five words.  For
a template of n shingles, let s be the least power of two that is n or more.  A text is
cut into windows of 2 s shingles that start each s shingles, so that any stretch of s
shingles lies whole in one window.  Each window's MinHash has 48 bands of one row; one
equal band retrieves the template.  A window that holds at least 80 % of the template's
shingles resembles it by at least 0.8 n / (2 s + 0.2 n) >= 0.19, so it is retrieved with
probability 1 - 0.81^48 > 0.9999.  A retrieved template counts if the window really
contains at least 80 % of its shingles, compared word by word.

Defined results: a null or empty text matches nothing; a text of fewer than five words
has no shingle; rows that share an id are scanned apart and reported together (the best
containment, then the earliest place); extra columns are ignored; templates of fewer
than five words are refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import texts_of
from .common import LOWEST, prepare, public_id, table

SHINGLE, THRESHOLD, BANDS = 5, 0.8, 48
#: Words whose windows are hashed at once.
PIECE = 1 << 17
WORD = re.compile(rb"[a-z0-9]+")

#: Notices to look for: (license, text).  A parameter of `scan`.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # bytes: lowers A-Z only


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    h = np.array([zlib.crc32(w) for w in words], np.uint32)
    n = len(h) - SHINGLE + 1
    out = np.zeros(max(n, 0), np.uint32)
    for i in range(SHINGLE):
        out = out * np.uint32(0x85EBCA6B) + h[i : i + len(out)]
    return out ^ (out >> np.uint32(16))


_BAND = np.random.default_rng(5).integers(1, 2**32, (BANDS, 2), dtype=np.uint64).astype(np.uint32)


def band_values(hashes: np.ndarray, band: int) -> np.ndarray:
    """One permutation of the hashes (odd multiplier: a bijection, then mixed)."""
    x = hashes * (_BAND[band, 0] | np.uint32(1)) + _BAND[band, 1]
    x ^= x >> np.uint32(15)
    return x * np.uint32(0x2C1B3C6D)


class Index:
    """Templates by size class: band minima, and exact shingles."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float = THRESHOLD):
        self.threshold, self.names, self.shingles, self.stride = threshold, [], [], []
        self.classes: dict[int, list[int]] = {}
        for name, text in templates:
            words = words_of(text.encode())
            if len(words) < SHINGLE:
                raise ValueError(f"a template needs {SHINGLE} words: {text!r}")
            found = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
            self.classes.setdefault(1 << (len(found) - 1).bit_length(), []).append(len(self.names))
            self.stride.append(1 << (len(found) - 1).bit_length())
            self.names.append(name)
            self.shingles.append(found)
        hashes = [shingle_hashes(words_of(t.encode())) for _, t in templates]
        #: per class and band: sorted minima, the templates they belong to, and a filter by the top 16 bits
        self.bands = {}
        for s, members in self.classes.items():
            for b in range(BANDS):
                low = np.array([band_values(hashes[m], b).min() for m in members], np.uint32)
                by = np.argsort(low)
                maybe = np.zeros(1 << 16, bool)
                maybe[low >> np.uint32(16)] = True
                self.bands[s, b] = low[by], np.array(members)[by], maybe

    def candidates(self, hashes: np.ndarray, filler: np.ndarray) -> set[tuple[int, int]]:
        """(first shingle of a window, template) of every window that shares a band; filler: places that hold no shingle."""
        found = set()
        for b in range(BANDS):
            values = band_values(hashes, b)
            values[filler] = 0xFFFFFFFF
            for s in self.classes:
                low = values.reshape(-1, s).min(axis=1) if s > 1 else values.copy()
                low[:-1] = np.minimum(low[:-1], low[1:])
                minima, members, maybe = self.bands[s, b]
                hit = np.flatnonzero(maybe[low >> np.uint32(16)])
                if len(hit):
                    left, right = np.searchsorted(minima, low[hit]), np.searchsorted(minima, low[hit], side="right")
                    for w, x, y in zip(hit.tolist(), left.tolist(), right.tolist(), strict=True):
                        found.update((w * s, int(m)) for m in members[x:y])
        return found

    def scan(self, texts: list[list[bytes]]) -> list[tuple[int, int, float, int]]:
        """(text, template, containment, first word) of the templates in each text; the best window of each, the earliest of equals.

        The texts lie end to end, each from a multiple of the largest stride and followed
        by at least that many fillers, so that no window reaches from one into the next.
        """
        stride = max(self.classes)
        counts = np.array([max(0, len(w) - SHINGLE + 1) for w in texts])
        room = (counts + 2 * stride - 1) // stride * stride
        begin = np.cumsum(room) - room
        hashes, filler = np.zeros(room.sum(), np.uint32), np.ones(room.sum(), bool)
        for w, at, n in zip(texts, begin.tolist(), counts.tolist(), strict=True):
            if n:
                hashes[at : at + n] = shingle_hashes(w)
                filler[at : at + n] = False
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for place, template in self.candidates(hashes, filler):
            text = int(np.searchsorted(begin, place, side="right")) - 1
            first, s = place - int(begin[text]), self.stride[template]
            here = texts[text][first : first + 2 * s + SHINGLE - 1]
            want = self.shingles[template]
            have = {tuple(here[i : i + SHINGLE]) for i in range(len(here) - SHINGLE + 1)}
            share = len(want & have) / len(want)
            if share >= self.threshold:
                best[text, template] = max(best.get((text, template), (0.0, 0)), (share, -first))
        return [(d, t, share, -first) for (d, t), (share, first) in sorted(best.items())]


def templates_of(table_: DataFrame, name_col: str = "license", text_col: str = "text", most_bytes: int = 16 << 20) -> list[tuple[str, str]]:
    """Templates from a table, such as one of full license texts; more than most_bytes of them are refused.

    Null texts and texts under five words are passed over; the order is that of names and texts.
    """
    rows = table_.select(F.col(f"`{name_col}`").alias("name"), F.col(f"`{text_col}`").alias("text")).filter("text IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of templates: more than {most_bytes}")
    return [(r["name"], r["text"]) for r in rows.orderBy("name", "text").collect() if len(words_of(r["text"].encode())) >= SHINGLE]


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, template int, license, containment, start): start is the first word of the best window."""
    prepare(docs.sparkSession)
    index = Index(templates, threshold)
    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LOWEST)).alias("doc"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch["doc"].to_pylist(), texts_of(batch["text"]), strict=True):
                docs.append(doc)
                texts.append(words_of(text))
                size += len(texts[-1])
                if size >= PIECE:
                    yield report(docs, index.scan(texts))
                    docs, texts, size = [], [], 0
        if docs:
            yield report(docs, index.scan(texts))

    def report(docs, found):
        out = [(docs[d], t, index.names[t], share, first) for d, t, share, first in found]
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["doc", "template", "license", "containment", "start"])

    found = rows.mapInArrow(run, "doc long, template int, license string, containment double, start long")
    best = found.groupBy("doc", "template", "license").agg(F.max(F.struct("containment", (-F.col("start")).alias("start"))).alias("b"))
    return best.select("doc", "template", "license", "b.containment", (-F.col("b.start")).alias("start"))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(public_id().alias("doc_id"), "template", "license", "containment", F.col("start").alias("start_word"))
