"""What several operators need: session settings, tables that cut lineage, document rows."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The smallest long: a missing document id sorts (and counts) as this one.
LOWEST = -(2**63)


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on; all are ordinary runtime SQL settings.

    Arrow batches stay small enough for long texts, and the shuffle files of a finished
    SQL execution (a table that was written) are removed at once.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    for key, value in (
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)),
        ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"),
    ):
        try:
            spark.conf.set(key, value)
        except Exception as e:  # a setting of newer releases only
            if "CANNOT_MODIFY" not in str(e) and "not found" not in str(e).lower():
                raise


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where it is unset, a fresh one, on one machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spreadworks-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    gc.collect()
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize returned and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def small(written: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast a written table if it is counted to be small; else joins shuffle."""
    return F.broadcast(written) if written.count() <= most else written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc long, copy int, text string) of documents.

    A null id counts as the smallest long, a null text as empty.  copy tells rows that
    share an id apart (0, 1, ... by text, identical rows share a number's result); the
    numbering only runs when an id repeats.
    """
    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LOWEST)).alias("doc"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    if rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return rows.select("doc", F.lit(0).alias("copy"), "text")
    by = Window.partitionBy("doc").orderBy("text")
    return rows.withColumn("copy", (F.row_number().over(by) - 1).cast("int")).select("doc", "copy", "text")


def public_id(column: str = "doc"):
    """The id as the caller gave it: null where it was missing."""
    return F.when(F.col(column) != F.lit(LOWEST), F.col(column))
