"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tokenizer A encodes a space and the text, tokenizer B the text (it adds the space
itself).  Both token lists are byte ranges of one string.  Per piece of documents, in
numpy: ``cumsum`` of token lengths gives the ends, ``intersect1d`` of both the common
cuts, ``searchsorted`` the group of each token, and a repeat-based expansion all links,
that is all pairs of an A and a B token of one group.

The corpus-wide count of an id pair is the number of documents that hold it linked.
Texts are encoded once: a piece (some 8 MiB of text) is written as its documents, each
with its distinct pairs as places in the piece's list of pairs, and that list.  The
lists are cut by buckets of pairs and summed in two shuffles: first by (bucket, salt of
the piece), so that a bucket full of frequent pairs is many small groups, then by bucket.
A third sum-like step gives each A id's highest count, again salted.  The counts go back
the same way, as one row per piece and bucket, and meet the piece's documents.  What
moves are packed lists of distinct pairs per piece, never one row per link.

Defined results: a null or empty text, or one whose A or B tokens do not spell space +
text byte for byte, has no tokens: zeros and an empty digest.  Each row is a document:
repeated ids and rows count as often as they stand there; a null id stays null.  Special
tokens' strings are plain text.  Texts are encoded whole, however long.  Empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, prepare, table

#: The tokenizers' files; a parameter of every function that encodes.
FILES = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")
#: Text of a piece, of what is expanded at once (bytes), and links expanded at once.
PIECE, STEP, LINKS = 8 << 20, 1 << 20, 4_000_000
#: Buckets of pairs, and salts of pieces: groups of the first shuffle.
BUCKETS, SALTS = 256, 16

#: Fixed value: how the byte-level pre-tokenizer cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these code points alone are cut alike by any Unicode version; others are encoded by the file's own library.
COMMON = re.compile("[\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧‰-⁞€]*")
#: A space beside any of these is no plain cut between two words.
BESIDE = [x for w in " \t\n\r" for x in (w + " ", " " + w)]
#: Words remembered at most (those of one step of text in any case).
WORDS = 400_000


def byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: bytes that print stand for themselves, the others for 256, 257, ..."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers: encoders, the bytes of each id, and the ids' lengths."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(open(path_a, encoding="utf-8").read())
        self.slow = Tokenizer.from_str(json.dumps(spec))
        self.slow.encode_special_tokens = True
        model, pre, stand = spec["model"], spec["pre_tokenizer"], byte_of()
        ids = {bytes(stand[c] for c in t): i for t, i in model["vocab"].items() if all(c in stand for c in t)}
        special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        merged = [bytes(stand[c] for c in "".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        order = [ids.get(m, -1) for m in merged]
        plain = spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and all(bytes([b]) in ids for b in range(256))
        # merges in the order of their ids are ranks: the faster encoder gives the same ids
        self.fast = None
        if plain and -1 not in order and all(x < y for x, y in zip(order, order[1:], strict=False)):
            self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={t: i for t, i in ids.items() if t not in special}, special_tokens={})
        self.a_bytes = [b""] * self.slow.get_vocab_size()
        for t, i in (special | ids).items():
            self.a_bytes[i] = t
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        # B never joins what stands before a space with it: words are encoded apart, and once
        self.by_words = not any(" " in t.decode("utf-8", "replace").lstrip(" ") for t in self.b_bytes)
        self.words: dict[str, list[int] | None] = {}
        self.a_size, self.b_size = (np.array([len(t) for t in x]) for x in (self.a_bytes, self.b_bytes))
        #: text of a token in a digest: A within a group, A at its end, B within, B at its end
        self.shown = [b"%d%s" % (i, end) for x, ends in ((self.a_bytes, (b",", b"|")), (self.b_bytes, (b",", b";"))) for end in ends for i in range(len(x))]

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return b"" if self.b.is_control(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def spelled(self, ids: list[int], table: list[bytes], text: str) -> list[int] | None:
        """The ids, or None if they do not spell space + text."""
        return ids if b"".join(map(table.__getitem__, ids)) == (" " + text).encode() else None

    def in_a(self, text: str) -> list[int] | None:
        if self.fast and COMMON.fullmatch(text):
            return self.fast.encode_ordinary(" " + text)  # bytes are never lost: nothing to compare
        return self.spelled(self.slow.encode(" " + text, add_special_tokens=False).ids, self.a_bytes, text)

    def in_b(self, texts: list[str]) -> list[list[int] | None]:
        """B ids of texts.  Where every space stands alone between words, the words' ids are the text's, and a word is encoded once."""
        cut = [t.split(" ") if self.by_words and COMMON.fullmatch(t) and t[0] not in " \t\n\r" and t[-1] != " " and not any(x in t for x in BESIDE) else None for t in texts]
        new = list({w for words in cut if words for w in words} - self.words.keys())
        if len(self.words) + len(new) > WORDS:
            self.words.clear()
            new = list({w for words in cut if words for w in words})
        self.words.update(zip(new, self._checked(new), strict=True))
        whole = iter(self._checked([t for t, words in zip(texts, cut, strict=True) if words is None]))
        out = []
        for words in cut:
            if words is None:
                out.append(next(whole))
                continue
            parts = list(map(self.words.__getitem__, words))
            out.append(None if None in parts else list(itertools.chain.from_iterable(parts)))
        return out

    def _checked(self, texts: list[str]) -> list[list[int] | None]:
        return [self.spelled(ids, self.b_bytes, t) for t, ids in zip(texts, self.b.encode(texts, num_threads=1), strict=True)] if texts else []

    def encoded(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """(A ids, B ids) of each text, both empty where it has no tokens."""
        full = [t for t in texts if t]
        both = iter(zip(map(self.in_a, full), self.in_b(full), strict=True))
        out = []
        for t in texts:
            a, b = next(both) if t else (None, None)
            out.append(([], []) if a is None or b is None else (a, b))
        return out


@functools.cache
def pair(path_a: str, path_b: str) -> Pair:
    """Loaded once by each worker."""
    return Pair(path_a, path_b)


def _first(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(counts, at)


def links(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, A id, B id) of all links as one number (doc << 40 | A id * width + B id), and how often each is linked.

    doc: the document of each group.  Long groups are linked by distinct ids, the others expanded in steps.
    """
    na, nb = np.bincount(group_a, minlength=len(doc)), np.bincount(group_b, minlength=len(doc))
    first_a, first_b, size = _first(na), _first(nb), na * nb
    keys, counts = [], []
    for g in np.flatnonzero(size > LINKS // 4).tolist():
        (x, nx), (y, ny) = (np.unique(ids[f[g] : f[g] + n[g]], return_counts=True) for ids, f, n in ((a, first_a, na), (b, first_b, nb)))
        for i in range(0, len(x), max(1, LINKS // len(y))):  # a block of A ids at a time
            part = slice(i, i + max(1, LINKS // len(y)))
            keys.append(((doc[g] << 40) + x[part, None] * width + y).ravel())
            counts.append((nx[part, None] * ny).ravel())
    size = np.where(size > LINKS // 4, 0, size)
    upto = np.cumsum(size)
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LINKS, side="right")))
        tokens = slice(first_a[at], first_a[stop - 1] + na[stop - 1])
        of = group_a[tokens]
        times = np.where(size[of] > 0, nb[of], 0)
        of = np.repeat(of, times)
        inner = np.arange(len(of)) - np.repeat(_first(times), times)
        found, n = np.unique((doc[of] << 40) + np.repeat(a[tokens], times) * width + b[first_b[of] + inner], return_counts=True)
        keys.append(found)
        counts.append(n)
        at = stop
    return _summed(np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def aligned(both: Pair, texts: list[str | None]):
    """Per text n_a, n_b, n_groups, n_links and the digest of its groups; and the links of all (see ``links``; doc: place in texts)."""
    tokens = both.encoded(texts)
    n_a, n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
    a, b = (np.fromiter(itertools.chain.from_iterable(t[k] for t in tokens), np.int64, n.sum()) for k, n in ((0, n_a), (1, n_b)))
    if not len(a):
        zero = np.zeros(len(texts), np.int64)
        return n_a, n_b, zero, zero, [""] * len(texts), (zero[:0], zero[:0])
    end_a, end_b = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    some = np.flatnonzero(n_a)
    doc = some[np.searchsorted(end_a[np.cumsum(n_a)[some] - 1], cuts)]
    na, nb = np.bincount(group_a), np.bincount(group_b)
    n_groups, n_links = np.bincount(doc, minlength=len(texts)), np.zeros(len(texts), np.int64)
    np.add.at(n_links, doc, na * nb)
    # digests: A tokens of a group, then its B tokens
    last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
    places = np.empty(len(a) + len(b), np.int64)
    places[np.arange(len(a)) + _first(nb)[group_a]] = a + last_a * len(both.a_bytes)
    places[np.arange(len(b)) + np.cumsum(na)[group_b]] = b + last_b * len(both.b_bytes) + 2 * len(both.a_bytes)
    shown, end, digests = both.shown.__getitem__, np.cumsum(n_a + n_b).tolist(), []
    for i, n in enumerate((n_a + n_b).tolist()):
        digests.append(hashlib.sha256(b"".join(map(shown, places[end[i] - n : end[i]].tolist()))[:-1]).hexdigest() if n else "")
    return n_a, n_b, n_groups, n_links, digests, links(a, b, group_a, group_b, doc, len(both.b_bytes))


#: A piece's documents (pairs: places in the piece's list, times: how often linked) and its lists of pairs by bucket.
ROW = "piece long, bucket int, id long, n_a long, n_b long, n_groups long, n_links long, digest string, pairs binary, times binary"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _batch(ddl: str, rows: list) -> pa.RecordBatch:
    schema = _schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _deltas(x: np.ndarray, kind=np.uint32) -> bytes:
    """Ascending numbers as differences, which compress well."""
    return np.diff(x, prepend=x.dtype.type(0)).astype(kind).tobytes()


def _upto(x: bytes, kind=np.uint32) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, kind).astype(np.int64))


def bucket_of(pairs: np.ndarray) -> np.ndarray:
    """Bucket of a pair: a hash of both ids."""
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % BUCKETS


def encoder(files: tuple[str, str], piece_size: int, step_size: int):
    """mapInArrow function: (id, text) to ROW."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(*files)
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        number, size, rows, keys, counts = 0, 0, [], [], []

        def step(ids, texts):
            *columns, digests, (found, n) = aligned(both, texts)
            keys.append(found + (len(rows) << 40))
            counts.append(n)
            rows.extend(zip(ids, *(c.tolist() for c in columns), digests, strict=True))

        def piece():
            key, n = np.concatenate(keys), np.concatenate(counts)
            pairs, place, documents = np.unique(key & ((1 << 40) - 1), return_inverse=True, return_counts=True)
            # places are numbered by bucket first, so that the counts come back as one run for each bucket
            bucket = bucket_of(pairs)
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            place = rank[place]
            ends = np.searchsorted(key, np.arange(1, len(rows) + 1) << 40).tolist()
            for at in range(0, len(rows), 500):
                out = []
                for i in range(at, min(at + 500, len(rows))):
                    part = slice(ends[i - 1] if i else 0, ends[i])
                    by = np.argsort(place[part])
                    out.append((task + number, None, *rows[i], _deltas(place[part][by]), n[part][by].astype(np.uint32).tobytes()))
                yield _batch(ROW, out)
            pairs, documents, bucket = pairs[order], documents[order], bucket[order]
            cut = np.searchsorted(bucket, np.arange(BUCKETS + 1)).tolist()
            yield _batch(ROW, [(task + number, k, *[None] * 6, _deltas(pairs[cut[k] : cut[k + 1]]), documents[cut[k] : cut[k + 1]].astype(np.uint32).tobytes()) for k in range(BUCKETS) if cut[k] < cut[k + 1]] or [(task + number, 0, *[None] * 6, b"", b"")])

        ids, texts, waiting = [], [], 0
        for batch in batches:
            for i, t in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                waiting += 4 + len(t or "")
                if waiting >= step_size:
                    step(ids, texts)
                    size += waiting
                    ids, texts, waiting = [], [], 0
                    if size >= piece_size:
                        yield from piece()
                        number, size, rows, keys, counts = number + 1, 0, [], [], []
        if ids:
            step(ids, texts)
        if rows:
            yield from piece()

    return run


SUM = "bucket int, salt int, pairs binary, counts binary"
HIGHEST = "id_a long, highest long"
REPLY = "piece long, bucket int, counts binary, best binary"


def summed(lists: DataFrame, by: list[str]) -> DataFrame:
    """SUM rows: the lists (bucket, salt, pairs, counts as 64 bits) of each group as one.  Lists stream by and are merged some at a time."""

    def run(batches):
        last, waiting, size = None, [], 0

        def merged():
            return _summed(np.concatenate([p for p, _ in waiting]), np.concatenate([c for _, c in waiting]))

        def done():
            pairs, counts = merged()
            return _batch(SUM, [(last[0], last[1] if len(last) > 1 else 0, _deltas(pairs), counts.tobytes())])

        for batch in batches:
            for *key, p, c in zip(*(batch[n].to_pylist() for n in (*by, "pairs", "counts")), strict=True):
                if key != last and waiting:
                    yield done()
                    waiting, size = [], 0
                last = key
                waiting.append((_upto(p), np.frombuffer(c, np.int64)))
                size += len(waiting[-1][0])
                if size > 1_000_000 and size > 2 * len(waiting[0][0]):
                    waiting = [merged()]
                    size = len(waiting[0][0])
        if waiting:
            yield done()

    return lists.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, SUM)


def corpus_counts(rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(totals as SUM rows by bucket, HIGHEST rows) of a written table of ROW."""

    def widened(batches):
        for batch in batches:
            counts = [np.frombuffer(c, np.uint32).astype(np.int64).tobytes() for c in batch["times"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["bucket"], batch["salt"], batch["pairs"], pa.array(counts, pa.binary())], schema=_schema(SUM))

    salt = F.pmod(F.xxhash64("piece"), F.lit(SALTS)).cast("int").alias("salt")
    lists = rows.filter("bucket IS NOT NULL").select("bucket", salt, "pairs", "times").mapInArrow(widened, SUM)
    totals = materialize(summed(summed(lists, ["bucket", "salt"]), ["bucket"]), "totals")

    def best(batches):
        for batch in batches:
            for p, c in zip(batch["pairs"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                ids, counts = _upto(p) // width, np.frombuffer(c, np.int64)
                if len(ids):
                    at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.maximum.reduceat(counts, at))], schema=_schema(HIGHEST))

    highest = totals.mapInArrow(best, HIGHEST).groupBy("id_a").agg(F.max("highest").alias("highest"))
    return totals, materialize(highest, "highest")


def replies(rows: DataFrame, totals: DataFrame, highest: DataFrame, width: int, size_a: int) -> DataFrame:
    """REPLY rows: the corpus-wide counts of each piece's lists, and which are their A id's highest.

    highest has a row for each id of A's vocabulary at most, so it travels with the function.
    """
    top = np.zeros(size_a, np.int64)
    for r in highest.toLocalIterator():
        top[r["id_a"]] = r["highest"]
    sent = rows.sparkSession.sparkContext.broadcast(top.tobytes())

    def run(batches):
        top = np.frombuffer(sent.value, np.int64)
        bucket = pairs = counts = best = None
        for batch in batches:
            out = []
            for k, piece, p, c in zip(*(batch[n].to_pylist() for n in ("bucket", "piece", "pairs", "counts")), strict=True):
                if piece is None:  # the bucket's totals come first
                    bucket, pairs, counts = k, _upto(p), np.frombuffer(c, np.int64)
                    best = counts == top[pairs // width]
                    continue
                at = np.searchsorted(pairs, _upto(p)) if k == bucket else np.zeros(0, np.int64)
                out.append((piece, k, counts[at].tobytes() if len(at) else b"", best[at].tobytes() if len(at) else b""))
            if out:
                yield _batch(REPLY, out)

    asked = rows.filter("bucket IS NOT NULL").select("bucket", "piece", "pairs", F.lit(None).cast("binary").alias("counts"), F.pmod(F.xxhash64("piece"), F.lit(SALTS)).cast("int").alias("salt"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    told = totals.select("bucket", F.lit(None).cast("long").alias("piece"), "pairs", "counts", salts)
    both = asked.unionByName(told).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", F.col("piece").asc_nulls_first())
    return both.select("bucket", "piece", "pairs", "counts").mapInArrow(run, REPLY)


RESULT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, digest string"


def align(docs: DataFrame, files: tuple[str, str] = FILES, piece: int = PIECE, step: int = STEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT rows, one for each document."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = materialize(source.mapInArrow(encoder(files, piece, step), ROW), "aligned")
    both = pair(*files)
    width, size_a = len(both.b_bytes), len(both.a_bytes)
    totals, highest = corpus_counts(rows, width)
    answers = materialize(replies(rows, totals, highest, width, size_a), "answers")
    discard(totals, highest)

    def run(batches):
        count = best = np.zeros(0, np.int64)
        piece, heard = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch[n].to_pylist() for n in ("piece", "bucket", "counts", "best", "id", "n_a", "n_b", "n_groups", "n_links", "digest", "pairs", "times")), strict=True):
                if row[0] != piece:
                    piece, heard = row[0], []
                if row[1] is not None:  # a piece's counts come before its documents, in the order of its list
                    heard.append(row[2:4])
                    continue
                if heard:
                    count, best = np.frombuffer(b"".join(c for c, _ in heard), np.int64), np.frombuffer(b"".join(b for _, b in heard), np.bool_)
                    heard = []
                *own, digest, pairs, times = row[4:]
                at, n = _upto(pairs), np.frombuffer(times, np.uint32).astype(np.int64)
                out.append((*own, int(n[best[at]].sum()), sum(_halves(n, count[at])), digest))
            if out:
                yield _batch(RESULT, out)

    own = ["id", "n_a", "n_b", "n_groups", "n_links", "digest", "pairs", "times"]
    told = answers.select("piece", "bucket", "counts", "best", *[F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in own])
    asked = rows.filter("bucket IS NULL").select("piece", "bucket", *[F.lit(None).cast("binary").alias(c) for c in ("counts", "best")], *own)
    return told.unionByName(asked).repartition("piece").sortWithinPartitions("piece", F.col("bucket").asc_nulls_last()).mapInArrow(run, RESULT)


def _halves(n: np.ndarray, count: np.ndarray) -> tuple[int, int]:
    """The exact sum of n * count as two parts: the counts' low 31 bits and the rest."""
    return int((n * (count & 0x7FFFFFFF)).sum()), int((n * (count >> 31)).sum()) << 31


def op12_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    found = align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("digest").alias("groups_sha256"))
