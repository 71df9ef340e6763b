"""Exact top-k search: ball trees over shards of near vectors, branch and bound on inner products.

Vectors are dealt to the nearest of some pivots, a bounded sample of them; a cell of
many vectors is split further by hash.  For a cell with pivot c and radius r no inner
product with q exceeds q.c + |q| r.  A query first visits the cell where that bound is
highest, then the NEAR next ones, then whatever cell is left whose bound reaches its kth
score; after each round its kth score over all shards visited is shared, so that cells
under it are never sent there.  Each shard builds a ball tree; the same bound orders its
leaves, and the search stops where it falls under the query's current kth score.

A round sends only the shards that some query visits, each once, with the queries behind
it: they stream by, so a task holds one shard (about SHARD_ROWS vectors) whatever the
number of queries.

Components become floor(1024 x).  Products are exact: in doubles while every sum stays
under 2**53, else in whole numbers of any length (saturated to a long at the end).

Defined results: vectors that are null or hold null or non-finite components take no
part; vectors are compared with those of equal length only; rows with the query's own
id are never its candidates; of rows that share a query id the smallest vector (by
components) asks; repeated candidate rows all count; a null id is never a query; empty
vectors score 0; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWEST, discard, materialize, prepare, public_id, table

K, SCALE = 10, 1024
#: Vectors of a shard (roughly), and of a leaf of its tree.
SHARD_ROWS, LEAF_ROWS = 16_384, 256
#: Pivots of one vector length, and lengths that have pivots (others have one cell): the bound of what is broadcast.
CELLS, LENGTHS = 256, 16
#: Cells that a query visits in the second round.
NEAR = 4
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class BallTree:
    """Nodes in creation order: centre, radius, parent, rows (leaves only); rows of a leaf ascend by id."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS):
        self.x, self.ids = x, ids
        centre, radius, self.parent, self.rows = [], [], [], []
        stack = [(np.arange(len(x)), -1)]
        while stack:
            rows, parent = stack.pop()
            c = x[rows].mean(axis=0)
            far = np.sqrt(((x[rows] - c) ** 2).sum(axis=1))
            me = len(centre)
            centre.append(c)
            radius.append(far.max())
            self.parent.append(parent)
            split = len(rows) > leaf and far.max() > 0
            self.rows.append(None if split else rows[np.argsort(ids[rows], kind="stable")])
            if split:
                a = x[rows[far.argmax()]]
                b = x[rows[((x[rows] - a) ** 2).sum(axis=1).argmax()]]
                by = np.argsort((x[rows] - c) @ (a - b), kind="stable")
                half = len(rows) // 2
                stack += [(rows[by[half:]], me), (rows[by[:half]], me)]
        self.centre, self.radius = np.array(centre), np.array(radius)

    def search(self, q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), each (queries, k), best first, ties to the smaller id, -inf where there is none."""
        n = len(q)
        bound = q @ self.centre.T + np.sqrt((q * q).sum(axis=1))[:, None] * self.radius
        bound += 1e-9 * np.abs(bound) + 1e-6  # rounding never hides a candidate
        alive = np.empty(bound.shape, bool)
        for j, up in enumerate(self.parent):  # a node is open if it and all above it can reach the kth score
            alive[:, j] = bound[:, j] >= floor
            if up >= 0:
                alive[:, j] &= alive[:, up]
        leaves = np.array([j for j, r in enumerate(self.rows) if r is not None])
        reach = np.where(alive[:, leaves], bound[:, leaves], -np.inf)
        order = np.argsort(-reach, axis=1, kind="stable")
        score, found = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        kth = floor.copy()
        for step in range(len(leaves)):
            leaf = order[:, step]
            top = reach[np.arange(n), leaf]
            going = np.flatnonzero((top > -np.inf) & (top >= kth))
            if not len(going):
                break
            for one in np.unique(leaf[going]).tolist():
                asks = going[leaf[going] == one]
                rows = self.rows[leaves[one]]
                s = q[asks] @ self.x[rows].T
                s[q_ids[asks][:, None] == self.ids[rows][None, :]] = -np.inf
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                both_s = np.concatenate([score[asks], np.take_along_axis(s, best, axis=1)], axis=1)
                both_i = np.concatenate([found[asks], self.ids[rows][best]], axis=1)
                by = np.lexsort((both_i, -both_s), axis=1)[:, :k]
                score[asks], found[asks] = np.take_along_axis(both_s, by, axis=1), np.take_along_axis(both_i, by, axis=1)
                kth[asks] = np.maximum(kth[asks], score[asks, -1])
        return score, found


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _exact(x, ids, q, q_ids, k):
    """The same by whole numbers of any length, where doubles could round."""
    whole = [[int(c) for c in row] for row in x.tolist()]
    for row, own in zip(q.tolist(), q_ids.tolist(), strict=True):
        a = [int(c) for c in row]
        scored = sorted((-sum(u * v for u, v in zip(a, b, strict=True)), i) for b, i in zip(whole, ids.tolist(), strict=True) if i != own)
        for s, i in scored[:k]:
            yield own, i, max(-(2**63), min(2**63 - 1, -s))


class Cells:
    """Pivots of each vector length (without one: a single pivot, zero), and the radius of each cell around its pivot."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots, self.radius = pivots, {}

    def of(self, dim: int) -> np.ndarray:
        return self.pivots[dim] if dim in self.pivots else np.zeros((1, dim))

    def assign(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance) of each vector: the nearest pivot (not sure to be, for huge components; the distance is true)."""
        p = self.of(dim)
        with np.errstate(over="ignore", invalid="ignore"):
            near = np.argmin(np.nan_to_num((p * p).sum(axis=1) - 2 * (x @ p.T), nan=np.inf), axis=1) if len(p) > 1 else np.zeros(len(x), np.int64)
            far = np.sqrt(((x - p[near]) ** 2).sum(axis=1)) if dim else np.zeros(len(x))
        return near, np.nan_to_num(far * (1 + 1e-9), nan=np.inf)

    def bounds(self, dim: int, q: np.ndarray) -> np.ndarray:
        """(queries, cells): no inner product with a vector of the cell is higher; -inf for an empty cell."""
        if dim not in self.pivots:
            return np.full((len(q), 1), np.inf)
        radius = self.radius[dim]
        with np.errstate(over="ignore", invalid="ignore"):
            out = q @ self.of(dim).T + np.sqrt((q * q).sum(axis=1))[:, None] * np.maximum(radius, 0)
            out += 1e-9 * np.abs(out) + 1e-6  # rounding never hides a candidate
        return np.where(radius < 0, -np.inf, np.nan_to_num(out, nan=np.inf, posinf=np.inf, neginf=np.inf))


def _assigned(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            cell, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                cell[at], far[at] = cells.assign(dim, _matrix(batch["v"].take(pa.array(at)), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return run


def _routed(cells: Cells, first: int, last: int):
    """Cells that each query visits in a round: those at places first to last by bound whose bound reaches its kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            kth = batch["kth"].fill_null(-(2**62)).to_numpy(zero_copy_only=False)
            rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                bound = cells.bounds(dim, _matrix(batch["v"].take(pa.array(at)), dim))
                order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                reach = np.take_along_axis(bound, order, axis=1)
                r, c = np.nonzero((reach > -np.inf) & (reach >= kth[at][:, None]))
                rows.append(at[r])
                found.append(order[r, c])
            rows = np.concatenate(rows)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([taken["dim"], pa.array(np.concatenate(found).astype(np.int32)), taken["vec_id"], taken["v"], taken["kth"]], names=["dim", "cell", "vec_id", "v", "kth"])

    return run


def _search(k: int):
    """mapInArrow function over rows sorted by shard, vectors before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy() for c in ("dim", "cell", "sub", "kind")], axis=1)
            edge = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(keys)], strict=True):
                key, part = tuple(keys[lo][:3].tolist()), batch.slice(lo, hi - lo)
                if key != shard:
                    shard, held, tree = key, [], None
                x, ids = _matrix(part["v"], key[0]), part["vec_id"].to_numpy()
                if keys[lo][3] == 0:
                    held.append((x, ids))
                elif held or tree:
                    if tree is None:
                        tree, held = BallTree(*(np.concatenate(c) for c in zip(*held, strict=True))), []
                    yield answers(tree, x, ids, part["kth"].fill_null(-(2**62)).to_numpy(zero_copy_only=False).astype(np.float64))

    def answers(tree: BallTree, q, q_ids, floor) -> pa.RecordBatch:
        most = float(max(np.abs(tree.x).max(initial=0), 1)) * float(max(np.abs(q).max(initial=0), 1)) * max(q.shape[1], 1)
        if most >= 2.0**53:
            rows = list(_exact(tree.x, tree.ids, q, q_ids, k))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], schema=FOUND)
        score, found = tree.search(q, q_ids, floor, k)
        row, place = np.nonzero(score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (q_ids[row], found[row, place], score[row, place].astype(np.int64))], schema=FOUND)

    return run


def _pivots(rows: DataFrame) -> Cells:
    """A bounded sample of the vectors as pivots: about one for each SHARD_ROWS, at most CELLS, for the LENGTHS most frequent lengths."""
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "dim").limit(LENGTHS)
    found: dict[int, np.ndarray] = {}
    for r in sizes.collect():
        cells = min(CELLS, -(-r["n"] // SHARD_ROWS))
        if cells > 1 and r["dim"] > 0:
            dealt = F.xxhash64("vec_id", "v")
            share = F.pmod(dealt, F.lit(1 << 40)) < F.lit(int(min(1.0, 8 * cells / r["n"]) * (1 << 40)))
            picked = rows.filter((F.col("dim") == r["dim"]) & share).select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(cells).collect()
            found[r["dim"]] = np.array([p["v"] for p in picked], np.float64).reshape(-1, r["dim"]) if picked else np.zeros((1, r["dim"]))
    return Cells(found)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score); is_query: a Column over vec_id."""
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col(f"`{vector_col}`")
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.filter(good).select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LOWEST)).alias("vec_id"),
        F.transform(v, lambda c: c.cast("double") * F.lit(float(scale))).alias("v"),
    )
    # floor stays a double: a component may lie beyond the longs
    rows = rows.withColumn("v", F.transform("v", lambda c: F.when(F.abs(c) < F.lit(2.0**52), F.floor(c).cast("double")).otherwise(c))).withColumn("dim", F.size("v"))
    plain = materialize(rows, "vectors")
    asks = plain.filter(is_query & (F.col("vec_id") != LOWEST)).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("m")).select("vec_id", "m.dim", "m.v")
    asks = materialize(asks, "queries")
    cells = _pivots(plain)
    rows = materialize(plain.mapInArrow(_assigned(cells), "vec_id long, v array<double>, dim int, cell int, far double"), "cells")
    discard(plain)
    sizes = rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).withColumn("subs", F.ceil(F.col("n") / SHARD_ROWS).cast("int"))
    sizes = materialize(sizes, "sizes")  # a row for each cell: at most CELLS * LENGTHS, and one for each other length
    several = sizes.filter(F.col("dim").isin(list(cells.pivots))) if cells.pivots else sizes.limit(0)
    for dim, p in cells.pivots.items():
        cells.radius[dim] = np.full(len(p), -1.0)
    for r in several.select("dim", "cell", "radius").collect():
        cells.radius[r["dim"]][r["cell"]] = r["radius"]
    rows = rows.join(sizes.select("dim", "cell", "subs"), ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("vec_id", "v"), F.col("subs")).cast("int"))

    def round_of(queries: DataFrame, first: int, last: int) -> DataFrame:
        sent = queries.select("dim", "vec_id", "v", "kth").mapInArrow(_routed(cells, first, last), "dim int, cell int, vec_id long, v array<double>, kth long")
        sent = sent.join(sizes.select("dim", "cell", "subs"), ["dim", "cell"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        sent = materialize(sent.select("dim", "cell", "sub", F.lit(1).alias("kind"), "vec_id", "v", "kth"), "sent")
        visited = sent.select("dim", "cell", "sub").distinct()
        here = rows.select("dim", "cell", "sub", F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("long").alias("kth")).join(visited, ["dim", "cell", "sub"], "left_semi")
        dealt = here.unionByName(sent).repartition("dim", "cell", "sub").sortWithinPartitions("dim", "cell", "sub", "kind")
        out = materialize(_best(dealt.mapInArrow(_search(k), "query_id long, vec_id long, score long"), k).drop("rank"), "found")
        discard(sent)
        return out

    found = round_of(asks.withColumn("kth", F.lit(None).cast("long")), 0, 1)
    for first, last in ((1, 1 + NEAR), (1 + NEAR, CELLS)) if cells.pivots else ():
        # the kth score of the shards visited: the final kth is never below it
        kth = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k).select("vec_id", "kth")
        more = found.unionByName(round_of(asks.join(kth, "vec_id", "left"), first, last))
        found, before = materialize(_best(more, k).drop("rank"), "best"), found
        discard(before)
    return _best(found, k).select("query_id", "rank", public_id("vec_id").alias("vec_id"), "score")


def op6_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES = {
    "op6_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
""",
}
