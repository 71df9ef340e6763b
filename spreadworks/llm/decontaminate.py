"""Benchmark decontamination: size-partitioned MinHash containment search, all in DataFrame functions.

A test item is short and may lie anywhere in a long document, so it is its containment
(the share of the item's five-word shingles that the document has) that counts, not
resemblance.  Items are partitioned by size (powers of two); an item's sketch is the K
smallest of its shingle hashes, K being fixed per partition.  At containment t an item
of n shingles may miss floor((1 - t) n) of them, so K is chosen above that number for
the largest n of the partition, and a document that contains the item shows at least
K - floor((1 - t) n) sketch hashes: the search loses nothing.  Candidates are verified by
exact shingle containment on the shingles themselves: candidate documents' shingles meet
candidate items' by hash and text, and each pair's distinct ones are counted.

Words are the lower-cased text split at ASCII white space.  Defined results: a null or
empty text or item has no shingles and matches nothing; an item of fewer than five words
has one shingle, its whole sequence, and matches only texts that are that sequence; rows
that share an id are searched apart and reported once per item (the larger containment);
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, prepare, public_id, table

SHINGLE, THRESHOLD = 5, 0.8
SPACES = "\t\n\x0b\x0c\r"
#: Sketch rows that are broadcast (24 bytes each); beyond it the search is a shuffled join.
BROADCAST_ROWS = 500_000
#: Residues of hashes by which rows are filtered before such a shuffle (8 bytes each, broadcast).
RESIDUES = 1 << 20


def words(text):
    """Lower-cased words; literal replaces and a one-character split stay clear of regular expressions."""
    text = F.lower(text)
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def shingle_hash(w, i, n: int = SHINGLE):
    """Hash of the n words from place i; a place beyond the end is null and adds nothing to the hash."""
    return F.xxhash64(*[F.get(w, i + k) for k in range(n)])


def places(w, n: int = SHINGLE):
    """Where shingles start (fewer than n words: one, the whole sequence; none: null, which explodes to nothing)."""
    return F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))))


def shingle_texts(w, n: int = SHINGLE):
    """Distinct shingles themselves."""
    count = F.greatest(F.size(w) - (n - 1), F.lit(1))
    made = F.transform(F.sequence(F.lit(1), count), lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(n))))
    return F.when(F.size(w) > 0, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def text_digest(column: str):
    """Tells the texts of rows that share an id apart."""
    return F.md5(F.coalesce(F.col(f"`{column}`"), F.lit("")).cast("binary"))


def test_hash(column: str):
    """Hash of a shingle's text."""
    return F.xxhash64(F.col(column))


def with_hashes(rows: DataFrame, table_: DataFrame) -> DataFrame:
    """rows joined on hash with a written table: broadcast if it is counted to be small, else shuffled.

    Before a shuffle, rows whose hash falls on no residue of the table's hashes go; the residues are at most RESIDUES rows.
    """
    if table_.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table_), "hash")
    residues = table_.select(F.pmod("hash", F.lit(RESIDUES)).alias("residue")).distinct()
    near = rows.join(F.broadcast(residues), F.pmod(rows["hash"], F.lit(RESIDUES)) == F.col("residue"), "left_semi")
    return near.join(table_, "hash")


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item, hash, need): the K smallest hashes of each item, K by size partition; need: how many a match shows at least."""
    rows = items.select("item", F.array_distinct(F.transform(places(F.col("w")), lambda i: shingle_hash(F.col("w"), i))).alias("hashes"))
    rows = rows.withColumn("n", F.size("hashes")).filter("n > 0")
    largest = F.pow(F.lit(2.0), F.length(F.bin("n"))) - 1  # of the partition: n of as many binary digits
    may_miss = F.lit(round(1 - threshold, 9))
    rows = rows.withColumn("k", F.least("n", F.floor(largest * may_miss).cast("int") + 1))
    rows = rows.withColumn("need", F.greatest(F.col("k") - F.floor(F.col("n") * may_miss + 1e-9).cast("int"), F.lit(1)))
    return rows.select("item", "need", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), F.col("k"))).alias("hash"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc, digest, item, n_shingles, n_shared, containment) of every pair of a row and an item at or above the threshold; digest: text_digest of the row."""
    prepare(docs.sparkSession)
    rows = numbered(docs, id_col, text_col)
    tests = items.select(F.col(f"`{item_col}`").alias("item"), words(F.coalesce(F.col(f"`{item_text_col}`"), F.lit(""))).alias("w"))
    tests = materialize(tests.withColumn("test_row", F.xxhash64("item", F.array_join("w", " "))).dropDuplicates(["item", "w"]).select("item", F.col("test_row"), "w"), "items")
    sketch = sketches(tests.select(F.struct("item", "test_row").alias("item"), "w"), threshold)
    sketch = materialize(sketch.select("item.item", "item.test_row", "need", "hash"), "sketches")
    # one span of generated code from the split to the join: places are exploded, shingles never are an array
    split = rows.select("doc", "copy", words(F.col("text")).alias("w"))
    hashed = split.select("doc", "copy", "w", F.explode(places(F.col("w"))).alias("i")).select("doc", "copy", shingle_hash(F.col("w"), F.col("i")).alias("hash"))
    hits = with_hashes(hashed, sketch).distinct().groupBy("doc", "copy", "item", "test_row").agg(F.count(F.lit(1)).alias("hits"), F.first("need").alias("need"))
    candidates = materialize(hits.filter("hits >= need").select("doc", "copy", F.col("item").alias("c_item"), F.col("test_row").alias("c_row")), "candidates")
    # exact: the shingles of candidate documents meet those of candidate items, as texts; a pair is a key, never a copy of a text
    chosen = tests.join(candidates.select("c_item", "c_row").distinct(), F.col("item").eqNullSafe(F.col("c_item")) & (F.col("test_row") == F.col("c_row")), "left_semi")
    full = chosen.select("item", "test_row", shingle_texts(F.col("w")).alias("tests")).select("item", "test_row", F.size("tests").cast("long").alias("n_shingles"), F.explode("tests").alias("test"))
    full = materialize(full.withColumn("hash", test_hash("test")), "tests")
    texts = rows.join(candidates.select("doc", "copy").distinct(), ["doc", "copy"], "left_semi")
    split = texts.select("doc", "copy", text_digest("text").alias("digest"), words(F.col("text")).alias("w"))
    shown = split.select("doc", "copy", "digest", "w", F.explode(places(F.col("w"))).alias("i")).select("doc", "copy", "digest", F.concat_ws(" ", F.slice("w", F.col("i") + 1, F.lit(SHINGLE))).alias("shown"))
    met = with_hashes(shown.withColumn("hash", test_hash("shown")), full).filter("shown = test")
    pairs = met.groupBy("doc", "copy", "digest", "item", "test_row", "n_shingles", "test").agg(F.lit(1).alias("one"))
    shared = pairs.groupBy("doc", "copy", "digest", "item", "test_row", "n_shingles").agg(F.count(F.lit(1)).alias("n_shared"))
    names = candidates.select(F.col("doc").alias("c_doc"), F.col("copy").alias("c_copy"), "c_item", "c_row")
    on = (F.col("doc") == F.col("c_doc")) & (F.col("copy") == F.col("c_copy")) & F.col("item").eqNullSafe(F.col("c_item")) & (F.col("test_row") == F.col("c_row"))
    exact = shared.join(names, on, "left_semi").select("doc", "digest", "item", "n_shingles", "n_shared")
    return exact.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(F.col("containment") >= threshold)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, **columns) -> DataFrame:
    """(doc, item, n_shingles, n_shared, containment) of every pair of an id and an item at or above the threshold."""
    exact = contained(docs, items, threshold, **columns)
    best = exact.groupBy("doc", "item").agg(F.max(F.struct("containment", "n_shingles", "n_shared")).alias("b"))
    return best.select("doc", "item", "b.n_shingles", "b.n_shared", "b.containment")


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(public_id().alias("doc_id"), F.col("item").alias("item_id"), "n_shingles", "n_shared", "containment")


#: Contaminated pairs of tables d (documents) and benchmark as SQL.
PAIRS_SQL = r"""
dw AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM d),
iw AS (SELECT item_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, text, array_to_string(list_slice(w, i, i + 4), ' ') AS s
       FROM dw, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS t(i)),
bs AS (SELECT DISTINCT item_id, text, array_to_string(list_slice(w, i, i + 4), ' ') AS s
       FROM iw, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS t(i)),
bn AS (SELECT item_id, text, count(*) AS n FROM bs GROUP BY ALL),
pr AS (SELECT ds.doc_id, ds.text AS dt, bs.item_id, bs.text AS it, count(*) AS k FROM ds JOIN bs USING (s) GROUP BY ALL),
pc AS (SELECT doc_id, pr.item_id, n, k, k::DOUBLE / n AS c FROM pr JOIN bn ON bn.item_id IS NOT DISTINCT FROM pr.item_id AND bn.text = pr.it WHERE k::DOUBLE / n >= 0.8),
pairs AS (SELECT doc_id, item_id, max(c) AS containment, arg_max(n, (c, n))::BIGINT AS n_shingles, arg_max(k, (c, n))::BIGINT AS n_shared FROM pc GROUP BY doc_id, item_id)
"""
ORACLES = {"op3_benchmark_decontamination": f"WITH d AS (SELECT doc_id, text FROM documents), {PAIRS_SQL} SELECT doc_id, item_id, n_shingles, n_shared, containment FROM pairs"}
