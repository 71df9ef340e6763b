"""Phrase collocation mining: phrases of 2 to 4 words whose words come together more often than apart.

A text, A-Z lower-cased, is split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into
words.  All counts are per language.

1. Words are counted, combined in the tasks first.  Those found 30 times or more get ids
   1, 2, ... in the order of language and word: the dictionary.  Nothing else can be part
   of a candidate, so a piece is broken at every other word.
2. At each place the ids of the next four words (0 after a break) are one key of 16
   bytes.  A task sorts its keys by radix passes, adds up equal ones and deals them out
   by ranges of keys.  The ranges come from a sample of keys, whose size is bounded; they
   decide how even the parts are and nothing else.
3. Of a range, equal leading 2, 3 or 4 ids are runs of the sorted keys; their lengths are
   the counts.  A run that touches an end of the range may go on in the next one: it
   is summed with its rest afterwards, two rows for each range and length at most.
4. Candidates (30 times or more) meet the counts of their parts, are scored by exact
   decimals, and lose those inside a longer candidate that is nearly as frequent.

The dictionary travels to the tasks if it has at most ``FEW_WORDS`` words; a larger one
meets the texts by a shuffle: groups of texts with just the words they hold.

Defined results: a null or empty text has no words; a null language is ``und``, one with
the language of that name; a null id counts like any other, repeated rows count each
time; ties of score and count go by the phrase's bytes; texts are read whole, however
long.  Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, prepare, table

#: Times a phrase is found at least; share of a longer one's count that drops it (percent); rows of a language; factor of a score.
LEAST, NEARLY, TOP, SCALE = 30, 80, 2000, 2_000_000
#: Words of a dictionary that is sent to the tasks; keys that the ranges are fitted on, words they are drawn from; keys in a range, about.
FEW_WORDS, SAMPLE, SAMPLED_WORDS, RANGE = 1_000_000, 20_000, 4_000_000, 500_000
#: Words and keys that a task holds before it adds them up.
HELD_WORDS, HELD_KEYS = 200_000, 500_000
#: Groups of texts that meet their own part of a large dictionary: about this many bytes each.
GROUP = 32 << 20

_TABLE = bytes(ord("\n") if chr(b) in ".,;:!?\n\x0b\x0c\r" else ord(" ") if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in order, with b"\\n" between pieces (empty strings mean nothing)."""
    return text.encode().translate(_TABLE).replace(b"\n", b" \n ").split(b" ") if text else []


def counted_words(docs: DataFrame) -> DataFrame:
    """(lang, word, times) of (lang, text)."""
    ddl = "lang string, word string, times long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush():
            for lang, counts in held.items():
                counts.pop(b"\n", None)
                counts.pop(b"", None)
                if counts:
                    words = pa.array(list(counts), pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), words, pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "times"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from flush()
        yield from flush()

    return docs.select("lang", "text").mapInArrow(run, ddl).groupBy("lang", "word").agg(F.sum("times").alias("times"))


def dictionary(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, word, times, id) of the words found so often; ids from 1 without gaps, by language and word."""
    ranged = materialize(counts.filter(F.col("times") >= least).repartitionByRange("lang", "word").withColumn("part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    first = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("lang", "word"))
    out = materialize(ranged.join(F.broadcast(first), "part").select("lang", "word", "times", (F.col("first") + place).alias("id")), "dictionary")
    discard(ranged)
    return out


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows of 32-bit numbers, the first column leading: stable passes over 16 bits, the last ones first."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        top = int(column.max(initial=0))
        for shift in (0, 16):
            if top >> shift:
                order = order[np.argsort((column[order] >> shift).astype(np.uint16), kind="stable")]
    return order


def combined(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of keys (4 ids each) sorted, equal ones added up."""
    if not len(keys):
        return keys, times
    order = radix_order(list(keys.T))
    keys, times = keys[order], times[order]
    at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    return keys[at], np.add.reduceat(times, at)


def keys_of(ids: np.ndarray) -> np.ndarray:
    """The ids of four words from each place on, 0 from the first break on; places with two words at least."""
    a = np.append(ids, np.zeros(3, ids.dtype))
    n = len(ids)
    keys = np.stack([a[i : i + n] for i in range(4)], axis=1)
    for i in (2, 3):
        keys[keys[:, i - 1] == 0, i] = 0
    return keys[(keys[:, 0] > 0) & (keys[:, 1] > 0)]


def _encode(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    ids = np.fromiter(map(known.get, words, itertools.repeat(0)), np.int64, len(words))
    empty = np.fromiter(map(len, words), np.int64, len(words)) == 0
    return np.append(ids[~empty], 0).astype(np.uint32)


KEYS = "part int, keys binary, times binary"


def _packed(keys: np.ndarray, times: np.ndarray, bounds: list[bytes]) -> Iterator[pa.RecordBatch]:
    """KEYS rows of sorted keys, one for each range that has some."""
    raw = np.ascontiguousarray(keys.astype(">u4")).tobytes()
    cuts = [0]
    for bound in bounds:  # first key not below the bound
        low, high = cuts[-1], len(keys)
        while low < high:
            middle = (low + high) // 2
            if raw[16 * middle : 16 * middle + 16] < bound:
                low = middle + 1
            else:
                high = middle
        cuts.append(low)
    cuts.append(len(keys))
    out = [(i, np.diff(keys[a:b].T.astype(np.int64), axis=1, prepend=0).astype(np.int32).tobytes(), times[a:b].astype(np.uint32).tobytes()) for i, (a, b) in enumerate(itertools.pairwise(cuts)) if a < b]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "keys", "times"])


def _unpacked(keys: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(keys, np.int32).reshape(4, -1).astype(np.int64), axis=1).astype(np.uint32).T


class Windows:
    """Adds up the keys of (words, known) and deals them out; every: only each so many-th key, as a sample."""

    def __init__(self, bounds: list[bytes] | None, every: int, most: int):
        self.bounds, self.every, self.most, self.held, self.size = bounds, every, most, [], 0

    def add(self, words: list[bytes], known: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        self.held.append(keys_of(_encode(words, known)))
        self.size += len(self.held[-1])
        if self.size >= self.most:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            keys = np.concatenate(self.held)
            if self.every:
                keys = np.ascontiguousarray(keys[self.every // 2 :: self.every].astype(">u4"))
                yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary())], names=["key"])
            else:
                yield from _packed(*combined(keys, np.ones(len(keys), np.int64)), self.bounds)
            self.held, self.size = [], 0


def windows(docs: DataFrame, words: DataFrame, n_words: int, size: int, bounds: list[bytes] | None, every: int = 0, few: int = FEW_WORDS, held: int = HELD_KEYS) -> DataFrame:
    """KEYS rows (with every: sampled keys) of the texts; a dictionary of more than `few` words meets them by a shuffle."""
    ddl = "key binary" if every else KEYS
    if n_words <= few:
        known: dict[str, dict[bytes, int]] = {}
        for r in words.select("lang", "word", "id").toLocalIterator():
            known.setdefault(r["lang"], {})[r["word"].encode()] = r["id"]
        sent = docs.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            work, none = Windows(bounds, every, held), {}
            for batch in batches:
                for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    yield from work.add(words_of(text), sent.value.get(lang, none))
            yield from work.out()

        return docs.select("lang", "text").mapInArrow(run, ddl)

    # texts in groups of one language; a group asks for its own words alone
    groups = max(1, size // GROUP)
    texts = docs.select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(groups)).alias("group"))

    def own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = set()

        def flush():
            rows = list(zip(*asked, strict=True))
            asked.clear()
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()).cast(pa.string())], names=["lang", "group", "word"])

        for batch in batches:
            for lang, text, group in zip(*(batch[c].to_pylist() for c in ("lang", "text", "group")), strict=True):
                asked.update((lang, group, w) for w in words_of(text) if w and w != b"\n")
                if len(asked) > HELD_WORDS:
                    yield from flush()
        if asked:
            yield from flush()

    asked = texts.mapInArrow(own_words, "lang string, group long, word string").distinct()
    told = asked.join(words.select("lang", "word", "id"), ["lang", "word"]).select("lang", "group", "word", "id", F.lit(None).cast("string").alias("text"))
    both = told.unionByName(texts.select("lang", "group", F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("id"), "text"))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, last, known = Windows(bounds, every, held), None, {}
        for batch in batches:
            for lang, group, word, i, text in zip(*(batch[c].to_pylist() for c in ("lang", "group", "word", "id", "text")), strict=True):
                if (lang, group) != last:
                    last, known = (lang, group), {}
                if i is not None:
                    known[word.encode()] = i
                    continue
                yield from work.add(words_of(text), known)
        yield from work.out()

    return both.repartition("lang", "group").sortWithinPartitions("lang", "group", F.col("id").asc_nulls_last()).select("lang", "group", "word", "id", "text").mapInArrow(grouped, ddl)


COUNTS = "gram array<int>, times long, open boolean"


def run_lengths(dealt: DataFrame, parts: int, least: int) -> DataFrame:
    """(gram, times) of all 2, 3 and 4 leading ids found so often.

    The sorted keys of a range are merged some lists at a time; runs at its ends are open, as the next range may go on with them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, times, waiting, size = None, None, None, [], 0

        def merged():
            return combined(np.concatenate([k for k, _ in waiting]), np.concatenate([t for _, t in waiting]))

        def grams(keys, times):
            for n in (2, 3, 4):
                mine = keys[:, n - 1] > 0
                k, t = keys[mine][:, :n], times[mine]
                if not len(k):
                    continue
                at = np.flatnonzero(np.append(True, (k[1:] != k[:-1]).any(axis=1)))
                total = np.add.reduceat(t, at)
                found = k[at]
                ends = (found == keys[0, :n]).all(axis=1) | (found == keys[-1, :n]).all(axis=1)
                out = np.flatnonzero((total >= least) | ends)
                if len(out):
                    flat = pa.array(found[out].astype(np.int32).ravel())
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(out) + 1, n, dtype=np.int32)), flat), pa.array(total[out]), pa.array(ends[out])], names=["gram", "times", "open"])

        for batch in batches:
            for p, k, t in zip(*(batch[c].to_pylist() for c in ("part", "keys", "times")), strict=True):
                if p != part and waiting:
                    yield from grams(*merged())
                    waiting, size = [], 0
                part = p
                waiting.append((_unpacked(k), np.frombuffer(t, np.uint32).astype(np.int64)))
                size += len(waiting[-1][0])
                if size > 2 * RANGE and size > 2 * len(waiting[0][0]):
                    waiting = [merged()]
                    size = len(waiting[0][0])
        if waiting:
            yield from grams(*merged())

    counts = materialize(dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, COUNTS), "runs")
    rest = counts.filter("open").groupBy("gram").agg(F.sum("times").alias("times"))
    return counts.filter("not open").select("gram", "times").unionByName(rest).filter(F.col("times") >= least)


def mine(docs: DataFrame, least: int = LEAST, nearly: int = NEARLY, few: int = FEW_WORDS, per_range: int = RANGE, held: int = HELD_KEYS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all candidates that stay."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text")).filter("text != ''")
    counts = materialize(counted_words(rows), "words")
    totals = materialize(counts.groupBy("lang").agg(F.sum("times").alias("n")), "totals")
    words = dictionary(counts, least)
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_words, size = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("times") * (F.octet_length("word") + 1)), F.lit(0))).first()
    discard(counts)

    # ranges of about per_range keys, from a sample of texts and of their keys
    parts = max(1, -(-total // per_range))
    thin = max(1, total // SAMPLED_WORDS)
    drawn = rows.filter(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(thin)) == 0)
    every = max(1, int(min(total, SAMPLED_WORDS) // SAMPLE))
    bounds: list[bytes] = []
    if parts > 1:
        keys = materialize(windows(drawn, words, n_words, size // thin, None, every, few, held), "sample")
        sample = sorted(bytes(r["key"]) for r in keys.toLocalIterator())
        discard(keys)
        bounds = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []

    grams = materialize(run_lengths(windows(rows, words, n_words, size, bounds, 0, few, held), len(bounds) + 1, least), "grams")
    ids = words.select(F.array(F.col("id").cast("int")).alias("gram"), "times")
    every_count = grams.unionByName(ids)

    # each candidate with the counts of both parts of each cut
    n = F.size("gram")
    cuts = grams.select("gram", F.col("times").alias("a"), F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    left = every_count.select(F.col("gram").alias("first"), F.col("times").alias("l"))
    right = every_count.select(F.col("gram").alias("rest"), F.col("times").alias("r"))
    cuts = cuts.withColumn("first", F.slice("gram", F.lit(1), F.col("k"))).join(left, "first")
    cuts = cuts.withColumn("rest", F.slice("gram", F.col("k") + 1, n - F.col("k"))).join(right, "rest")
    cuts = cuts.withColumn("score", F.expr(f"(cast(a as decimal(20, 0)) * {SCALE}) div (cast(l as decimal(20, 0)) + r)"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("gram", "a").agg(lowest).select("gram", "a", "cut.l", "cut.r", "cut.score")

    # what a longer candidate holds
    inner = F.expr("flatten(transform(sequence(2, size(gram) - 1), m -> transform(sequence(1, size(gram) - m + 1), i -> slice(gram, i, m))))")
    within = grams.filter(n > 2).select(F.explode(inner).alias("gram"), F.col("times").alias("outer"))
    within = within.groupBy("gram").agg(F.max("outer").alias("outer"))
    near = F.expr(f"cast(outer as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {int(nearly)}")
    kept = scored.join(within, "gram", "left").filter(F.col("outer").isNull() | ~near)

    # ids back to words, one place at a time
    spelled = words.select("lang", "word", F.col("id").cast("int").alias("id"))
    out = kept.select("*", F.posexplode("gram").alias("at", "id")).join(spelled, "id")
    out = out.groupBy("gram", "lang", "a", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return out.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mine(table(spark, sf_dir, "documents").select("lang", "text"))
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= TOP).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLES = {
    "op13_phrase_collocations": r"""
WITH p AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(part, '[^\x20\x09]+') AS words
           FROM (SELECT coalesce(lang, 'und') AS lang,
                        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part
                 FROM documents)),
g AS (SELECT lang, len(gram) AS m, gram, count(*)::BIGINT AS f
      FROM (SELECT lang, list_slice(words, i, i + m - 1) AS gram
            FROM p, unnest(range(1, 5)) AS s(m), unnest(range(1, len(words) - m + 2)) AS t(i))
      GROUP BY lang, gram),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE m > 1 AND f >= 30),
k AS (SELECT c.lang, c.gram, c.f AS a, k, x.f AS l, y.f AS r, (2000000 * c.f::HUGEINT // (x.f::HUGEINT + y.f))::BIGINT AS score
      FROM c, unnest(range(1, c.m)) AS t(k)
      JOIN g x ON x.lang = c.lang AND x.gram = list_slice(c.gram, 1, k)
      JOIN g y ON y.lang = c.lang AND y.gram = list_slice(c.gram, k + 1, c.m)),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1),
i AS (SELECT c.lang, list_slice(c.gram, i, i + m2 - 1) AS gram, max(c.f) AS outer_f
      FROM c, unnest(range(2, c.m)) AS s(m2), unnest(range(1, c.m - m2 + 2)) AS t(i) GROUP BY ALL),
d AS (SELECT b.lang, array_to_string(b.gram, ' ') AS phrase, a, l, r, score
      FROM b LEFT JOIN i USING (lang, gram) WHERE outer_f IS NULL OR 100 * outer_f::HUGEINT < 80 * a::HUGEINT)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM d JOIN n USING (lang) QUALIFY rank <= 2000
""",
}
