"""Exact top-k inner products by best-first search of an M-tree.

Integer vectors are lifted by one coordinate to one length, so that the largest inner product is the smallest distance.
Routing objects are a bounded, hashed sample of rows; above them stand a few of their own. Every row goes to its nearest
routing object, whose rows are cut into pages; a page keeps the range of its rows' distances to the parent, an inner node
its covering radius and its objects' distances to their parent. A query first bounds its k-th distance by the sampled
rows, then walks the nodes in order of their lower bounds. Stored parent distances exclude nodes, pages and rows by the
triangle inequality before a distance is computed. What survives is compared page by page, in blocks of queries.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.llm.common import stored

#: Routing objects and those above them, sampled rows that bound the first distances, rows of a page, queries of a block.
LEAVES, INNER, SAMPLE, PAGE, QUERIES = 256, 16, 4096, 2048, 4096
#: Relative slack of bounds, far above the rounding of distances and far below any difference that matters.
SLACK = 1e-9


def integer_vectors(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``(id, v)`` with ``floor(scale * x)`` of every component; rows that are null, or hold a null or non-finite one, go."""
    good = F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(key).isNotNull() & F.coalesce(good, F.lit(False))).select(
        F.col(key).alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column; shorter vectors end with zeros."""
    offsets, flat = np.asarray(column.offsets), np.asarray(column.values)
    size = np.diff(offsets)
    out = np.zeros((len(size), width))
    if len(flat):
        row = np.repeat(np.arange(len(size)), size)
        out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], size)] = flat[offsets[0]:offsets[-1]]
    return out


class Tree:
    """Inner nodes: routing objects with their lifted vectors, parents, distances to the parent and covering radii."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, square: float):
        self.square, self.ids, self.sample = square, ids, vectors
        lifted = self.lift(vectors)
        self.leaves = lifted[: min(LEAVES, len(lifted))]
        chosen, near = [0], np.linalg.norm(self.leaves - self.leaves[0], axis=1)
        while len(chosen) < min(INNER, len(self.leaves)):  # each next one is the farthest from those taken
            chosen.append(int(near.argmax()))
            near = np.minimum(near, np.linalg.norm(self.leaves - self.leaves[chosen[-1]], axis=1))
        self.inner = self.leaves[chosen]
        apart = self.distances(self.leaves, self.inner)
        self.parent = apart.argmin(1)
        self.to_parent = apart[np.arange(len(self.leaves)), self.parent]
        self.radius = np.zeros(len(self.leaves))
        self.least = np.zeros(len(self.leaves))
        self.used = np.zeros(len(self.leaves), bool)

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.square - (vectors * vectors).sum(1), 0)
        return np.concatenate([vectors, np.sqrt(rest)[:, None]], 1)

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        squares = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
        return np.sqrt(np.maximum(squares, 0))

    def cover(self, ranges: dict[int, tuple[float, float]]) -> None:
        """Covering radii of the leaves, from the distances of their rows, and of the nodes above them."""
        for leaf, (least, most) in ranges.items():
            self.used[leaf], self.least[leaf], self.radius[leaf] = True, least, most
        reach = np.where(self.used, self.to_parent + self.radius, 0)
        self.inner_radius = np.array([reach[self.parent == i].max(initial=0) for i in range(len(self.inner))])

    def first_bound(self, query: np.ndarray, own: int, k: int) -> float:
        """A distance within which ``k`` other rows are known to lie, from the sampled rows; infinite if they are too few."""
        scores = self.sample[self.ids != own] @ query
        if len(scores) < k:
            return np.inf
        kth = -np.partition(-scores, k - 1)[k - 1]
        return float(np.sqrt(max((query * query).sum() + self.square - 2 * kth, 0)))

    def search(self, query: np.ndarray, bound: float) -> list[tuple[int, float]]:
        """Leaves that may hold a row within ``bound``, with their distance to the query, in order of their lower bounds."""
        point, limit = np.append(query, 0.0), bound + SLACK * (1 + np.sqrt(self.square) + np.linalg.norm(query))
        above = self.distances(point[None], self.inner)[0]
        heap = [(max(d - self.inner_radius[i], 0.0), 0, i, d) for i, d in enumerate(above)]
        heapq.heapify(heap)
        found = []
        while heap and heap[0][0] <= limit:
            _, level, node, d = heapq.heappop(heap)
            if level:
                found.append((node, d))
                continue
            below = np.flatnonzero((self.parent == node) & self.used)
            below = below[np.abs(d - self.to_parent[below]) - self.radius[below] <= limit]  # not computed: too far by stored distances
            if len(below):
                for leaf, x in zip(below, self.distances(point[None], self.leaves[below])[0]):
                    heapq.heappush(heap, (max(x - self.radius[leaf], self.least[leaf] - x, 0.0), 1, int(leaf), float(x)))
        return found


def top_k(rows: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose key is divisible by ``every``, the ``k`` best other rows.

    The score is the inner product of the integer vectors (sums stay below 2^53); ties go to the smaller key; fewer
    candidates give fewer rows. A row without key or with a null, null-holding or non-finite vector takes no part. Rows
    with the query's key are its own; repeated query rows are one query; repeated candidates count as often as they
    stand. Shorter vectors are filled up with zeros. An empty table gives no rows. No other column is read.
    """
    spark = rows.sparkSession
    clean = integer_vectors(rows, key, vector, scale)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    size = clean.agg(F.max(F.size("v")), F.max(square), F.count(F.lit(1))).first()
    if not size[2]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, kind = size[0], clean.schema["id"].dataType.simpleString()
    sample = clean.select("id", "v", F.xxhash64(F.lit("route"), "id").alias("h")).orderBy("h", "id").limit(SAMPLE).toArrow()
    tree = Tree(np.asarray(sample.column("id").combine_chunks()), _matrix(sample.column("v").combine_chunks(), width), float(size[1] or 0))
    held = spark.sparkContext.broadcast(tree)

    def assign(batches):
        for batch in batches:
            own = held.value
            x = _matrix(batch.column(1), width)
            apart = own.distances(own.lift(x), own.leaves)
            leaf = apart.argmin(1)
            yield pa.RecordBatch.from_arrays([
                pa.array(leaf.astype(np.int32)), pa.array(apart[np.arange(len(x)), leaf]), batch.column(0),
                pa.array([r.tobytes() for r in x], pa.binary())], ["leaf", "d", "id", "x"])

    placed = stored(clean.select("id", "v").mapInArrow(assign, f"leaf int, d double, id {kind}, x binary"), "mtree-rows")
    leaves = placed.groupBy("leaf").agg(F.min("d").alias("least"), F.max("d").alias("most"), F.count(F.lit(1)).alias("n"))
    leaves = F.broadcast(stored(leaves, "mtree-leaves"))  # at most LEAVES rows
    tree.cover({r.leaf: (r.least, r.most) for r in leaves.collect()})
    covered = spark.sparkContext.broadcast(tree)
    pages = placed.join(leaves.select("leaf", F.ceil(F.col("n") / PAGE).alias("cuts")), "leaf").withColumn(
        "page", F.pmod(F.xxhash64("id"), "cuts").cast("int")).select("leaf", "page", "d", "id", "x")
    ranges = stored(pages.groupBy("leaf", "page").agg(F.min("d").alias("least"), F.max("d").alias("most")), "mtree-pages")

    def walk(batches):
        for batch in batches:
            own, out = covered.value, []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                query = np.frombuffer(x)
                bound = own.first_bound(query, i, k)
                out += [(leaf, d, i, x, bound) for leaf, d in own.search(query, bound)]
            cols = list(zip(*out)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([
                pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.float64()), pa.array(cols[2], batch.schema.field(0).type),
                pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.float64())], ["leaf", "dq", "query", "xq", "bound"])

    asked = placed.where(F.col("id") % every == 0).select("id", "x").dropDuplicates(["id"])
    blocks = max(1, -(-asked.count() // QUERIES))
    wanted = asked.mapInArrow(walk, f"leaf int, dq double, query {kind}, xq binary, bound double")
    slack = SLACK * (1 + 2 * float(np.sqrt(tree.square)))
    wanted = wanted.join(ranges, "leaf").where(
        (F.col("dq") - F.col("most") <= F.col("bound") + slack) & (F.col("least") - F.col("dq") <= F.col("bound") + slack))
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    filled = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else pages.withColumn("block", F.lit(0))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """A page's rows against a block of queries; rows outside a query's ring around the parent are not computed."""
        parts = []
        if len(left) and len(right):
            x, d, ids = np.stack([np.frombuffer(b) for b in left.x]), left.d.to_numpy(), left.id.to_numpy()
            for s in range(0, len(right), 256):
                some = right.iloc[s:s + 256]
                q, limit = np.stack([np.frombuffer(b) for b in some.xq]), some.bound.to_numpy()[:, None] + slack
                ring = np.abs(some.dq.to_numpy()[:, None] - d) <= limit
                inside = np.flatnonzero(ring.any(0))
                scores = q @ x[inside].T
                scores[~ring[:, inside] | (ids[inside] == some["query"].to_numpy()[:, None])] = -np.inf
                for row, query in zip(scores, some["query"]):
                    best = np.lexsort((ids[inside], -row))[:k] if len(row) <= 4 * k else None
                    if best is None:
                        least = -np.partition(-row, k - 1)[k - 1]
                        best = np.flatnonzero(row >= least)
                        best = best[np.lexsort((ids[inside][best], -row[best]))][:k]
                    best = best[np.isfinite(row[best])]
                    parts.append(pd.DataFrame({"query_id": query, "vec_id": ids[inside][best], "score": row[best].astype(np.int64)}))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    by = ["leaf", "page", "block"]
    near = filled.groupBy(by).cogroup(wanted.select(*by, "dq", "query", "xq", "bound").groupBy(by)).applyInPandas(
        compare, f"query_id {kind}, vec_id {kind}, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
