"""Approximate nearest neighbours: stable projections in a kd-tree, with a chi-square stopping test.

Vectors are projected to ``DIMS`` Gaussian coordinates, so the squared projected distance
over the squared true distance is chi-square distributed.  A top kd-tree, fitted on at most
``SAMPLE`` projected vectors, cuts projected space into cells of about ``BLOCK`` vectors, up to
``CELLS`` of them; every vector is routed to its cell, and each cell (in pieces of at most some
``2 * BLOCK`` vectors) has a kd-tree of its own.  A query takes its projected neighbours in
growing order and verifies their true distances; it stops when a vector as near as its current
``k``-th would, with probability ``SURE``, already have come.  It is asked in its own cell first
and then only in cells whose box is within the test's reach of the ``k``-th found there.  The
cells follow from the vectors alone, so results do not depend on the cluster.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part,
and neither do rows without id; equal distances go to the smaller id; a query is never compared
with rows of its own id; rows that repeat an id are candidates each, and one query (its least
vector); vectors of another length are never compared; an empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import renamed, table
from tessera.plans.scratch import discard, materialize

DIMS = 16
SURE = 0.98
LEAF = 64
#: Vectors a cell should hold, and queries that meet a piece of one at a time.
BLOCK, PART = 4096, 50_000
#: Vectors the top tree is fitted on, and its most cells.
SAMPLE, CELLS = 65_536, 4096


def chi_square_cdf(x: float, dims: int) -> float:
    """For an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(dims // 2):
        term = term * half / i if i else 1.0
        total += term
    return 1 - math.exp(-half) * total


def chi_square_quantile(p: float, dims: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, dims) < p else (lo, mid)
    return hi


@functools.lru_cache(maxsize=8)
def projection(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([10, dim])).standard_normal((dim, DIMS))


class KdTree:
    """Points halved at the median of their widest dimension, down to leaves of ``LEAF`` points with their boxes."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        leaves, work = [], [(0, len(points))]
        while work:
            a, b = work.pop()
            own = points[self.order[a:b]]
            if b - a <= LEAF:
                leaves.append((a, b))
                continue
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
            work += [(a, a + mid), (a + mid, b)]
        self.begin, self.end = (np.array(x) for x in zip(*sorted(leaves), strict=True))
        self.points = points[self.order]
        self.low = np.minimum.reduceat(self.points, self.begin)
        self.high = np.maximum.reduceat(self.points, self.begin)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Least squared distance from ``q`` to anything in each leaf."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (gap * gap).sum(axis=1)


@dataclasses.dataclass
class TopTree:
    """Axes and thresholds of the inner nodes, level by level; a point goes right where it is not below the threshold."""

    axis: np.ndarray
    threshold: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, depth: int) -> TopTree:
        axis, threshold = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        work = [(0, points)] if depth else []
        while work:
            node, own = work.pop()
            if node >= len(axis) or len(own) < 2:
                continue
            axis[node] = np.argmax(own.max(axis=0) - own.min(axis=0))
            threshold[node] = np.median(own[:, axis[node]])
            right = own[:, axis[node]] >= threshold[node]
            work += [(2 * node + 1, own[~right]), (2 * node + 2, own[right])]
        return cls(axis, threshold)

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(len(self.axis).bit_length()):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] >= self.threshold[node])
        return node - len(self.axis)


def search(tree: KdTree, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, limit: float, reach: float = np.inf) -> list[tuple[float, int]]:
    """The nearest found within a projected distance of ``reach``, as (distance, id); ``vectors`` and ``ids`` in the tree's order."""
    q = query @ projection(len(query))
    bound = tree.bounds(q)
    order = np.argsort(bound, kind="stable")
    slack = 1e-9 * float(q @ q)
    seen_d, seen_id = np.zeros(0), np.zeros(0, np.int64)
    wait_at, wait_p = np.zeros(0, np.int64), np.zeros(0)
    done, some = 0, 2
    while done < len(order) and bound[order[done]] <= reach:  # leaves open in growing numbers, nearest box first
        opened = order[done : done + some]
        done, some = done + some, 2 * some
        rows = np.concatenate([np.arange(tree.begin[x], tree.end[x]) for x in opened])
        gap = tree.points[rows] - q
        wait_at, wait_p = np.append(wait_at, rows), np.append(wait_p, np.einsum("ij,ij->i", gap, gap))
        horizon = bound[order[done]] if done < len(order) else np.inf
        wanted = wait_p <= reach  # the test has ended the search before all others
        ready = wanted & (wait_p <= horizon)  # nothing unopened is nearer in projection
        at = wait_at[ready]
        wait_at, wait_p = wait_at[wanted & ~ready], wait_p[wanted & ~ready]
        at = at[ids[at] != own]
        diff = vectors[at] - query
        seen_d, seen_id = np.append(seen_d, np.sqrt((diff * diff).sum(axis=1))), np.append(seen_id, ids[at])
        if len(seen_d) > k:
            near = np.flatnonzero(seen_d <= np.partition(seen_d, k - 1)[k - 1])
            best = near[np.lexsort((seen_id[near], seen_d[near]))[:k]]
            seen_d, seen_id = seen_d[best], seen_id[best]
        if len(seen_d) == k:
            reach = min(reach, limit * seen_d.max() ** 2 + slack)
            if min(horizon, wait_p.min() if len(wait_p) else np.inf) > reach:
                break
    best = np.lexsort((seen_id, seen_d))
    return [(float(seen_d[i]), int(seen_id[i])) for i in best]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _projected(batch: pa.RecordBatch) -> np.ndarray:
    """Projections of column v of a batch, whose vectors may differ in length."""
    out, dim = np.zeros((batch.num_rows, DIMS)), batch.column(batch.schema.get_field_index("dim")).to_numpy()
    vectors = batch.column(batch.schema.get_field_index("v"))
    for d in np.unique(dim):
        own = np.flatnonzero(dim == d)
        out[own] = _matrix(vectors.take(pa.array(own))) @ projection(int(d))
    return out


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sure: float = SURE) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found of every row for which ``queries`` (over column id) holds."""
    limit = chi_square_quantile(sure, DIMS)
    spark = vectors.sparkSession
    rows = renamed(vectors, id=id_col, v=vector_col).where("id IS NOT NULL").where(usable("v"))
    rows = materialize(rows.select(F.col("id").cast("long"), F.col("v").cast("array<double>"), F.size("v").alias("dim")), "nn-vectors")
    count = rows.count()
    depth = min(max(0, math.ceil(math.log2(max(1, count) / BLOCK))), CELLS.bit_length() - 1)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _projected(batch)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, c])) for c in range(DIMS)], names=[f"p{c}" for c in range(DIMS)])

    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).mapInArrow(project, ", ".join(f"p{c} double" for c in range(DIMS)))
    top = TopTree.fit(sample.toPandas().to_numpy(), depth) if depth else TopTree(np.zeros(0, np.int64), np.zeros(0))
    sent_top = spark.sparkContext.broadcast(top)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent_top.value.cells(_projected(batch)))], names=[*batch.schema.names, "cell"])

    placed = materialize(rows.mapInArrow(route, "id long, v array<double>, dim int, cell long"), "nn-cells")
    asked = placed.where(queries).groupBy("id").agg(F.min_by(F.struct("v", "dim", "cell"), "v").alias("q")).select("id", "q.*")
    asked = materialize(asked, "nn-queries")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            x, ids = _matrix(left.column("v")), left.column("id").to_numpy()
            tree = KdTree(x @ projection(x.shape[1]))
            x, ids = x[tree.order], ids[tree.order]
            for own, q, reach in zip(right.column("id").to_numpy(), _matrix(right.column("v")), right.column("reach").to_numpy(), strict=True):
                out += [(int(own), i, d) for d, i in search(tree, x, ids, q, int(own), k, limit, reach)]
        c = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(c[0], pa.int64()), "id": pa.array(c[1], pa.int64()), "score": pa.array(c[2], pa.float64())})

    where = ["dim", "cell", "piece", "part"]
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    pieces = materialize(placed.groupBy("dim", "cell").agg((F.floor(F.count(F.lit(1)) / (2 * BLOCK)) + 1).alias("pieces")), "nn-pieces")

    def answered(sent: DataFrame) -> DataFrame:
        """The ``k`` best of each query over the cells it is sent to (id, v, dim, cell, reach)."""
        parts = sent.groupBy("dim", "cell").agg((F.floor(F.count(F.lit(1)) / PART) + 1).alias("parts"))
        load = materialize(pieces.join(parts, ["dim", "cell"]), "nn-load")
        left = placed.join(load, ["dim", "cell"]).select("id", "v", "dim", "cell", F.pmod(F.xxhash64("id"), "pieces").alias("piece"), numbers("parts").alias("part"))
        right = sent.join(load, ["dim", "cell"]).select("id", "v", "dim", "cell", "reach", numbers("pieces").alias("piece"), F.pmod(F.xxhash64("id"), "parts").alias("part"))
        found = left.groupBy(*where).cogroup(right.groupBy(*where)).applyInArrow(answer, "query_id long, id long, score double")
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= k)

    first = materialize(answered(asked.withColumn("reach", F.lit(float("inf")))), "nn-own")

    # boxes of the cells that hold vectors: at most CELLS rows a coordinate
    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, cell = _projected(batch), batch.column(batch.schema.get_field_index("cell")).to_numpy()
            for c in np.unique(cell):
                own = p[cell == c]
                yield pa.RecordBatch.from_arrays([pa.array([c] * DIMS), pa.array(range(DIMS)), pa.array(own.min(axis=0)), pa.array(own.max(axis=0))], names=["cell", "axis", "low", "high"])

    boxes = placed.mapInArrow(extent, "cell long, axis long, low double, high double").groupBy("cell", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    boxes = boxes.sort_values(["cell", "axis"])
    sent_boxes = spark.sparkContext.broadcast((boxes["cell"].to_numpy()[::DIMS], boxes["low"].to_numpy().reshape(-1, DIMS), boxes["high"].to_numpy().reshape(-1, DIMS)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to the other cells within reach of the k-th found so far."""
        cells, low, high = sent_boxes.value
        for batch in batches:
            p, far = _projected(batch), batch.column(batch.schema.get_field_index("far")).to_numpy(zero_copy_only=False)
            own = batch.column(batch.schema.get_field_index("cell")).to_numpy()
            reach = limit * far**2 + 1e-9 * (p**2).sum(axis=1)
            row, cell = [], []
            for i in range(batch.num_rows):
                gap = np.maximum(np.maximum(low - p[i], p[i] - high), 0)
                near = cells[((gap * gap).sum(axis=1) <= reach[i]) & (cells != own[i])]
                row.append(np.full(len(near), i))
                cell.append(near)
            at = np.concatenate(row) if row else np.zeros(0, np.int64)
            kept = batch.select(["id", "v", "dim"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.concatenate(cell) if cell else at, pa.int64()), pa.array(reach[at])], names=["id", "v", "dim", "cell", "reach"])

    so_far = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("worst"))
    open_ = asked.join(so_far, asked.id == so_far.query_id, "left").select("id", "v", "dim", "cell", F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(float("inf"))).alias("far"))
    sent = materialize(open_.mapInArrow(spread, "id long, v array<double>, dim int, cell long, reach double"), "nn-sent")
    second = materialize(answered(sent), "nn-others")
    discard(rows, placed, asked, pieces, sent)
    both = first.unionByName(second).drop("rank")
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(100)) == 0)
