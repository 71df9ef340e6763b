"""A corpus pipeline of five stages over `documents`.

Toxic documents go; one document of each SimHash group stays (the one with the smallest
id); documents that contain a benchmark item go; sources are mixed to their target
weights (a document may be taken twice, or not at all); what is left is dealt into 40
shards.  Each stage is one operator of spreadworks.llm, works on all its predecessor
kept, and is written as Parquet before the next one reads it.  All stages but the last
return the columns of `documents`.

Defined results: a null or empty text is a document like any other (fingerprint zero,
no shingles, no words); a row without an id is a document of its own, which the SimHash
stage tells from others by its text (of equal texts without an id one stays); of rows
that share an id, one stays there (the first text in byte order); the other filtering
stages judge each row on its own.  Ties go to the smaller id.  A null source is a source of
its own.  Repeated rows stay repeated until the SimHash stage.  Columns whose names the
operators use themselves pass through unchanged.  Empty tables give an empty result;
without labels of both kinds every score is the share of toxic labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadworks.llm import decontaminate, mixing, sharding, simhash, toxicity
from spreadworks.llm.common import LOWEST, materialize, prepare, table

#: Not expressible: a trained network scores the first stage.
ORACLE_SQL = None


def _key():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))


def _fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _only(docs: DataFrame, names: list[str]) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in names])


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that the classifier rejects (score 0.5 or more) go."""
    prepare(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    name = _fresh(docs, "_toxicity")
    return _only(toxicity.score(docs, model, name=name).filter(F.col(name) < 0.5), docs.columns)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: of each component of linked fingerprints the smallest id stays; of rows that share it, the first text.

    A row without an id takes one from its text, below all others.  Should two texts without
    an id take the same, both stay with the component whose smallest id it is.
    """
    key, place, gone = (_fresh(docs, n) for n in ("_key", "_place", "_gone"))
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.lit(LOWEST) + 1 + F.shiftrightunsigned(F.xxhash64(text), 3)
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), own))
    groups = simhash.simhash_groups(keyed, id_col=key)
    out = groups.filter("doc != component").select(F.col("doc").alias(gone)).distinct()
    kept = keyed.join(out, F.col(key) == F.col(gone), "left_anti")
    if keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return _only(kept, docs.columns)
    by = Window.partitionBy(key, F.when(F.col("doc_id").isNull(), text)).orderBy("text")
    return _only(kept.withColumn(place, F.row_number().over(by)).filter(F.col(place) == 1), docs.columns)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: documents that contain 80 % or more of a benchmark item's shingles go; of rows that share an id, those alone."""
    found = decontaminate.contained(docs, table(spark, sf_dir, "benchmark"))
    doc, digest = _fresh(docs, "_gone"), _fresh(docs, "_digest")
    gone = found.select(F.col("doc").alias(doc), F.col("digest").alias(digest)).distinct()
    return docs.join(gone, (_key() == F.col(doc)) & (decontaminate.text_digest("text") == F.col(digest)), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: each document as often as the mix takes it."""
    prepare(spark)
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = mixing.take(docs, mixing.plan(docs), prefix=prefix)
    copies = F.explode(F.array_repeat(F.lit(1), F.col(prefix + "copies"))).alias(prefix + "copy")
    return _only(found.select("*", copies), docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: shard and slot of each document taken."""
    return sharding.contract(sharding.assign_shards(docs, sharding.tree(40), sharding.tree(41)))


STAGES = [
    ("toxicity", toxic_out),
    ("simhash_near_dedup", near_duplicates_out),
    ("benchmark_decontamination", benchmark_out),
    ("mixing_sources", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
