"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket.  Per source, the running sum over the
buckets tells in which bucket the budget ends; only that boundary bucket is refined by
the next bits of the hash, until one hash value is left.  The filter is then a
comparison of each document's hash (of its id and text) with its source's threshold: no
document is sorted.

Targets: all sources together are to give `total` (150 %) of all words, by weights 3, 1,
2, repeating over the sources in code point order, null last.  No target exceeds twice
its source; the excess is shared again by weight until none is above (water filling).

Defined results: a null text has 0 words; a null source is a source of its own; a null
id hashes as an empty string; rows equal in id and text are taken alike, so a source
misses its target by at most the words of such rows at the threshold; an empty source
has target 0 (its cap) and takes nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, prepare, small, table

WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2
#: Bits of a bucket, and levels of buckets: 4 x 12 of 48 bits.
BITS, LEVELS = 12, 4
WORDS = r"[^\x20\x09-\x0D]+"


def hash48(id_col: str, text_col: str):
    """48 bits of the MD5 of a row's id and text, the same in any SQL engine: rows without an id, or that share one, differ by text."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), text)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target).  One row per source: a table as small as the list of sources."""
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), (place + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("capped", F.coalesce(F.sum("cap").over(upto), F.lit(0)))
    rows = rows.withColumn("rest", F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0)))
    rows = rows.withColumn("rate", (F.sum("source_size").over(every) * F.lit(float(total)) - F.col("capped")) / F.col("rest"))
    # the sources whose cap is below their share at this rate come first in the order; the first that is not fixes the rate
    rows = rows.withColumn("full", F.col("cap") <= F.col("w") * F.col("rate"))
    rows = rows.withColumn("place", F.row_number().over(by))
    rate = F.min(F.when(~F.col("full"), F.struct("place", "rate"))).over(every)["rate"]
    rows = rows.withColumn("rate", rate)
    return rows.select("source", "source_size", F.when(F.col("rate").isNull() | F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("rate")).alias("target"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
    """(words, hash, source) columns of docs."""
    words = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORDS)), F.lit(0)).cast("long")
    return words, hash48(f"`{id_col}`", f"`{text_col}`"), F.col(f"`{source_col}`")


def plan(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(source, source_size, target, whole, limit) per source: every document whole times, once more if its hash is below limit."""
    words, h, source = sized(docs, id_col, text_col, source_col)
    rows = materialize(docs.select(source.alias("source"), words.alias("size"), h.alias("h")), "sizes")
    first = rows.groupBy("source", F.shiftright("h", BITS * (LEVELS - 1)).alias("bucket")).agg(F.sum("size").alias("words"))
    first = materialize(first, "histogram")
    wanted = targets(first.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    budget = wanted.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    budget = materialize(budget, "targets")
    # under: words below the boundary so far; prefix: the boundary's leading bits
    histogram = first
    state = budget.select("source", "budget", F.lit(0).cast("long").alias("under"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        if level:
            shift = BITS * (LEVELS - 1 - level)
            near = rows.join(small(state.select(F.col("source").alias("s"), "prefix")), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("prefix")))
            histogram = near.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = histogram.join(small(state.select(F.col("source").alias("s"), "budget", "under")), F.col("source").eqNullSafe(F.col("s")))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        run = run.withColumn("upto", F.col("under") + upto).filter("upto > budget")
        ends = run.groupBy("source").agg(F.min(F.struct("bucket", "upto", "words", "budget")).alias("e"))
        before, state = state, materialize(ends.select("source", F.col("e.budget").alias("budget"), (F.col("e.upto") - F.col("e.words")).alias("under"), F.col("e.bucket").alias("prefix"), F.col("e.words").alias("words")), "boundary")
        if level:
            discard(before)
    # one hash value is left: it is in if that comes nearer to the budget; no boundary: the budget takes every document
    nearer = F.col("under") + F.col("words") - F.col("budget") < F.col("budget") - F.col("under")
    limit = state.select(F.col("source").alias("s"), F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("limit"))
    out = budget.join(limit, F.col("source").eqNullSafe(F.col("s")), "left")
    done = materialize(out.select("source", "source_size", "target", "whole", F.coalesce("limit", F.lit(1 << (BITS * LEVELS))).alias("limit")), "plan")
    discard(rows, first, budget, state)
    return done


def take(docs: DataFrame, mix_plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", prefix: str = "mix_") -> DataFrame:
    """docs with columns mix_size, mix_source_size, mix_target and mix_copies (how often the mix takes the row)."""
    words, h, source = sized(docs, id_col, text_col, source_col)
    kept = docs.select("*", source.alias(prefix + "source"), words.alias(prefix + "size"), h.alias(prefix + "h"))
    names = mix_plan.select(*[F.col(c).alias(f"{prefix}p_{c}") for c in mix_plan.columns])
    out = kept.join(small(names), F.col(prefix + "source").eqNullSafe(F.col(prefix + "p_source")))
    extra = F.when((F.col(prefix + "size") > 0) & (F.col(prefix + "h") < F.col(prefix + "p_limit")), 1).otherwise(0)
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col(prefix + "size"),
        F.col(prefix + "p_source_size").alias(prefix + "source_size"),
        F.col(prefix + "p_target").alias(prefix + "target"),
        (F.col(prefix + "p_whole") + extra).cast("int").alias(prefix + "copies"),
    )


def op9_mixing_sources(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = take(docs, plan(docs))
    return found.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


#: The mix of a table d as SQL; hash buckets give the same documents as a running sum in hash order.
MIX_SQL = r"""
r AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS h FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w FROM r GROUP BY source),
o AS (SELECT *, 2 * source_size AS cap,
             coalesce(sum(2 * source_size) OVER q, 0)::BIGINT AS capped,
             (sum(w) OVER () - coalesce(sum(w) OVER q, 0))::BIGINT AS rest,
             sum(source_size) OVER ()::BIGINT AS every FROM s
      WINDOW q AS (ORDER BY (2 * source_size)::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, (every::DOUBLE * 1.5::DOUBLE - capped::DOUBLE) / rest::DOUBLE AS rate,
             row_number() OVER (ORDER BY cap::DOUBLE / w, source ASC NULLS LAST) AS place FROM o),
g AS (SELECT arg_min(rate, place) FILTER (WHERE cap > w * rate) AS fixed FROM p),
t AS (SELECT source, source_size, CASE WHEN fixed IS NULL OR cap <= w * rate THEN cap::DOUBLE ELSE w * fixed END AS target FROM p, g),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
c AS (SELECT r.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
             sum(size) OVER (PARTITION BY r.source ORDER BY h RANGE UNBOUNDED PRECEDING)::BIGINT AS upto,
             sum(size) OVER (PARTITION BY r.source, h)::BIGINT AS own
      FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source),
m AS (SELECT *, whole + CASE WHEN size > 0 AND (upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own)))
                             THEN 1 ELSE 0 END AS copies FROM c)
"""
ORACLES = {"op9_mixing_sources": f"WITH d AS (SELECT doc_id, text, source FROM documents), {MIX_SQL} SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM m"}
