"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every child draws ln(u) / weight, u being a hash of the document id and
the child's name, and the largest draw wins; the row descends into that child.  A
child's draw depends on nothing but its own name and weight, so a weight change moves
rows only into or out of the subtrees whose weights change.

`tree(n)` lays the first 40 shards out as 4 regions x 2 racks x 5 shards; each further
shard is a region of its own (one rack, one shard), so no other subtree changes its
weight and one more shard takes rows only into itself (law `key`).

Slots number a shard's rows from 0 without gaps: counts of (shard, id hash bucket) are
summed before anything is sorted, so no task ever holds a shard.

Defined results: a null id hashes as the text `null`; a null text has no bytes and CRC 0;
rows that share an id go to one shard; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, table

REGIONS, RACKS, SHARDS = 4, 2, 5
#: Hash buckets of a shard whose rows one task numbers, and bits of a draw.
BUCKETS, BITS = 4096, 52


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; leaves carry the shard number and their own weight."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(n: int, regions: int = REGIONS, racks: int = RACKS, shards: int = SHARDS, weights: dict[int, float] | None = None) -> Node:
    """n shards: the base layout in order, then a new region for each further shard."""
    out, number, w = [], 0, weights or {}
    while number < n:
        region = f"g{len(out)}"
        full = len(out) < regions
        found = []
        for r in range(racks if full else 1):
            leaves = tuple(Node(f"{region}/r{r}/s{i}", (), number + i, w.get(number + i, 1.0)) for i in range(min(shards if full else 1, n - number)))
            if leaves:
                found.append(Node(f"{region}/r{r}", leaves))
                number += len(leaves)
        out.append(Node(region, tuple(found)))
    return Node("", tuple(out))


def unit(key, name: str):
    """A draw's u in (0, 1): 52 bits of the MD5 of the id and the child's name."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit(":" + name)).cast("binary")), 1, BITS // 4), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << BITS))


def _levels(rows: DataFrame, root: Node, name: str) -> DataFrame:
    """Adds the shard number as column `name`, one projection a level: each level's draws are made once per row."""
    rows = rows.withColumn("_path", F.lit(""))
    level = [root]
    while any(n.children for n in level):
        step = None
        for n in level:
            if not n.children:
                here = F.lit(n.name)
            elif len(n.children) == 1:
                here = F.lit(n.children[0].name)
            else:
                here = F.array_max(F.array(*[F.struct((F.log(unit(F.col("_key"), c.name)) / F.lit(c.weight)).alias("draw"), F.lit(c.name).alias("name")) for c in n.children]))["name"]
            step = F.when(F.col("_path") == n.name, here) if step is None else step.when(F.col("_path") == n.name, here)
        rows = rows.withColumn("_path", step)
        level = [c for n in level for c in (n.children or (n,))]
    number = F.create_map(*[x for n in level for x in (F.lit(n.name), F.lit(n.shard))])
    return rows.withColumn(name, number[F.col("_path")]).drop("_path")


def assign_shards(docs: DataFrame, root: Node, grown: Node | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard): size is the text's bytes plus 16."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = _levels(rows, root, "shard")
    rows = _levels(rows, grown, "grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = rows.withColumn("bucket", (F.conv(F.substring(F.md5(F.col("_key").cast("binary")), 1, 3), 16, 10)).cast("int") % BUCKETS).drop("_key")
    rows = materialize(rows, "assigned")
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    out = rows.withColumn("place", place).join(base, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("place")).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, root: Node, path: str, id_col: str = "doc_id") -> None:
    """Write whole rows, one folder a shard; hot shards are split over tasks by the id's hash."""
    rows = _levels(docs.withColumn("_key", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))), root, "shard").drop("_key")
    rows.repartition(F.col("shard"), F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(16))).write.partitionBy("shard").parquet(path)


def contract(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return contract(assign_shards(table(spark, sf_dir, "documents"), tree(40), tree(41)))


def _draws_sql(rows: str, root: Node, column: str) -> str:
    """SQL of the descent: every node's draw, the best child of each level."""
    nodes = []

    def walk(n: Node, level: int) -> None:
        for c in n.children:
            nodes.append((n.name, c.name, float(c.weight), len(n.children), level, c.shard))
            walk(c, level + 1)

    walk(root, 0)
    values = ", ".join(f"('{p}', '{c}', {w}::DOUBLE, {k}, {v}, {s})" for p, c, w, k, v, s in nodes)
    sql = f"n_{column} AS (SELECT * FROM (VALUES {values}) t(parent, name, weight, siblings, level, shard)),\n"
    before = f"(SELECT k, '' AS path FROM {rows})"
    for level in range(3):
        draw = f"ln((('0x' || substr(md5(x.k || ':' || n.name), 1, {BITS // 4}))::BIGINT + 0.5::DOUBLE) / {float(1 << BITS)}::DOUBLE) / n.weight"
        sql += f"{column}{level} AS (SELECT x.k, arg_max(n.name, {draw}) AS path, arg_max(n.shard, {draw}) AS shard FROM {before} x JOIN n_{column} n ON n.parent = x.path GROUP BY x.k),\n"
        before = f"{column}{level}"
    return sql


#: CRC-32 (polynomial 0xEDB88320) of each text, byte by byte over a computed table, as SQL.
CRC_SQL = """
ct AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT for z in range(8)]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
  FROM range(256) t(i))),
tx AS (SELECT DISTINCT coalesce(text, '') AS text FROM d),
bx AS (SELECT text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM tx),
cr AS (SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM bx, ct),
"""
SHARD_SQL = (
    "k AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, 'null') AS k FROM d),\n"
    + _draws_sql("k", tree(40), "s")
    + _draws_sql("k", tree(41), "g")
    + """
a AS (SELECT doc_id, (strlen(coalesce(text, '')) + 16)::BIGINT AS size, coalesce(text, '') AS text, s2.shard::INT AS shard, g2.shard::INT AS grown_shard,
             ('0x' || substr(md5(s2.k), 1, 3))::INT AS bucket
      FROM d JOIN s2 ON s2.k = coalesce(doc_id::VARCHAR, 'null') JOIN g2 ON g2.k = s2.k)
"""
)
ORACLES = {
    "op5_sharding": "WITH d AS (SELECT doc_id, text FROM documents)," + CRC_SQL + SHARD_SQL + """
SELECT doc_id, size, crc::BIGINT AS text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, crc, size) - 1)::BIGINT AS slot, grown_shard
FROM a JOIN cr USING (text)
""",
}
