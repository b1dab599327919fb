"""Exact centroid clustering over zone maps: vectors in Hilbert order, cut into blocks with min/max boxes.

Vectors are ordered along a Hilbert curve through their principal axes (moments of all vectors) and packed into blocks; a
block keeps the least and the greatest value of every component, and its sums. In a round a block first looks at its box
alone: the centroid nearest to the box's middle is compared with every other one by the least difference that their squared
distances can have anywhere in the box, and those that are farther everywhere are out. Only blocks with several candidates
left look at their vectors, against the candidates only; the others give their stored sums. All numbers are integers, so
results are exact and do not depend on the order or the blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import stored

#: Axes of the curve and bits of each; vectors of a block; vectors that one task orders.
AXES, BITS, BLOCK, RANGE_ROWS = 6, 8, 512, 200_000
#: Integer components reach to this size at most, so that squared distances fit a long.
REACH = 1 << 27


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points with ``bits``-bit coordinates (rows of ``cells``), by exchange and inversion
    of the lower bits from the top bit down, then Gray code and interleaving."""
    x = cells.T.astype(np.int64).copy()
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in x:
            hit = axis >> bit & 1 == 1
            swap = np.where(hit, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(hit, low, swap)
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    keys = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in x ^ flip:
            keys = keys << 1 | axis >> bit & 1
    return keys


def integer_rows(rows: DataFrame, key: str, vector: str, width: int, scale: int) -> DataFrame:
    """``(id, v)`` with ``floor(scale * x)`` of every component of the vectors that have ``width`` finite ones."""
    good = (F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clipped = lambda x: F.greatest(F.lit(-float(REACH)), F.least(F.lit(float(REACH)), F.floor(x.cast("double") * scale).cast("double")))
    return rows.where(F.coalesce(good, F.lit(False))).select(
        F.col(key).alias("id"), F.transform(vector, lambda x: clipped(x).cast("int")).alias("v"))


def principal_axes(clean: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, leading axes (columns) and deviations along them, from sums and products over all vectors."""
    at = np.triu_indices(width + 1)

    def run(batches):
        sums = np.zeros((width + 1, width + 1))
        for batch in batches:
            x = np.ones((batch.num_rows, width + 1))
            x[:, 1:] = batch.column(0).flatten().to_numpy().reshape(-1, width)
            sums += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(sums[at])], ["i", "j", "x"])

    total = np.zeros((width + 1, width + 1))
    for r in clean.select("v").mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        total[r.i, r.j] = total[r.j, r.i] = r.x  # (width + 1) squared numbers, whatever the rows
    n = max(total[0, 0], 1)
    mean = total[0, 1:] / n
    values, axes = np.linalg.eigh(total[1:, 1:] / n - np.outer(mean, mean))
    return mean, axes[:, ::-1][:, :AXES], np.sqrt(np.maximum(values[::-1][:AXES], 1e-12))


def candidates(least: np.ndarray, most: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a point of the box: not farther than one of them everywhere."""
    apart = 2 * centroids - (least + most)
    near = centroids[(apart.astype(np.float64) ** 2).sum(1).argmin()]
    toward = centroids - near
    reach = np.where(toward > 0, most * toward, least * toward).sum(1)
    return np.flatnonzero((centroids * centroids).sum(1) - (near * near).sum() - 2 * reach <= 0)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the first of equals) and squared distance of every row, exactly."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)), 1)
    kind = np.float64 if 4 * x.shape[1] * top * top < 1 << 53 else np.int64  # doubles hold these integers
    x, centroids = x.astype(kind), centroids.astype(kind)
    apart = (x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * (x @ centroids.T)
    own = apart.argmin(1)
    return own, apart[np.arange(len(x)), own].astype(np.int64)


def _number(column, i: int, width: int, kind=np.int64) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), kind).reshape(-1, width)


def blocks_of(clean: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The vectors with their curve keys, and the blocks ``(ids, vectors, least, most, total)`` in curve order, both stored."""
    kind = clean.schema["id"].dataType.simpleString()
    mean, axes, deviation = principal_axes(clean, width)
    cells = 1 << BITS

    def keyed(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, width)
            along = ((x - mean) @ axes / deviation + 4) * (cells / 8)  # four deviations to either side
            keys = hilbert_keys(np.clip(along, 0, cells - 1).astype(np.int64), BITS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), batch.column(0), pa.array([r.tobytes() for r in np.ascontiguousarray(x, np.int32)], pa.binary())], ["h", "id", "v"])

    def packed(batches):
        for batch in batches:
            parts = []
            for s in range(0, batch.num_rows, BLOCK):
                some = batch.slice(s, BLOCK)
                raw = b"".join(some.column(1).to_pylist())
                x = np.frombuffer(raw, np.int32).reshape(-1, width).astype(np.int64)
                parts.append((some.column(0), raw, x.min(0).tobytes(), x.max(0).tobytes(), x.sum(0).tobytes()))
            ids, *rest = zip(*parts)
            edges = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(edges, pa.concat_arrays(ids)), *(pa.array(c, pa.binary()) for c in rest)],
                ["ids", "vectors", "least", "most", "total"])

    rows = stored(clean.mapInArrow(keyed, f"h long, id {kind}, v binary").withColumn("row", F.monotonically_increasing_id()), "zones-rows")
    parts = max(clean.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    ordered = rows.repartitionByRange(parts, "h", "row").sortWithinPartitions("h", "row").select("id", "v")
    return rows, stored(ordered.mapInArrow(
        packed, f"ids array<{kind}>, vectors binary, least binary, most binary, total binary"), "zones-blocks")


def cluster(
    rows: DataFrame, centroids: int = 16, rounds: int = 3, seed: int = 1, key: str = "vec_id", vector: str = "embedding",
    width: int = 64, scale: int = 64,
) -> tuple[DataFrame, list[list[int]]]:
    """``(key, cluster, distance, cluster_inertia, inertia)`` of every vector that takes part, and the final centroids.

    Components become ``floor(scale * x)`` (at most 2^27 in size). Vectors that are null, have not exactly ``width``
    components or hold a null or non-finite one take no part. The first centroids are the vectors with the smallest sha256 of
    ``seed:key``, in that order (a null key counts as empty text, equal keys follow the components); fewer vectors make
    fewer centroids, none an empty result. A round assigns every vector to the nearest centroid (squared distance, the
    smaller number of equals) and moves each centroid that has vectors to the floor of their mean. Repeated rows count as
    often as they stand; no other column is read.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    clean = integer_rows(rows, key, vector, width, scale)
    keyed, blocks = blocks_of(clean, width)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = keyed.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(centroids).collect()
    at = np.array([np.frombuffer(r.v, np.int32) for r in first], np.int64).reshape(-1, width)
    for _ in range(rounds if len(at) else 0):
        at = _moved(blocks, at)

    def assign(batches):
        for batch in batches:
            own, away = [], []
            for i in range(batch.num_rows):
                several = candidates(*(_number(batch.column(c), i, width)[0] for c in (2, 3)), at)
                place, distance = nearest(_number(batch.column(1), i, width, np.int32).astype(np.int64), at[several])
                own.append(several[place])
                away.append(distance)
            if own:
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).flatten(), pa.array(np.concatenate(own).astype(np.int32)), pa.array(np.concatenate(away))], ["id", "cluster", "distance"])

    placed = stored(blocks.select("ids", "vectors", "least", "most").mapInArrow(
        assign, f"id {kind}, cluster int, distance long"), "zones-placed")
    spent = {r.cluster: r.spent for r in placed.groupBy("cluster").agg(F.sum("distance").alias("spent")).collect()}  # a row per centroid
    table = spark.createDataFrame([(c, s) for c, s in spent.items()], "cluster int, cluster_inertia long")
    out = placed.join(F.broadcast(table), "cluster").select(
        F.col("id").alias(key), "cluster", "distance", "cluster_inertia", F.lit(sum(spent.values())).cast("long").alias("inertia"))
    return out, at.tolist()


def _moved(blocks: DataFrame, at: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    width = at.shape[1]

    def run(batches):
        totals, counts = np.zeros(at.shape, np.int64), np.zeros(len(at), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                several = candidates(*(_number(batch.column(c), i, width)[0] for c in (1, 2)), at)
                if len(several) == 1:  # the box decides: the vectors themselves are not looked at
                    totals[several[0]] += _number(batch.column(3), i, width)[0]
                    counts[several[0]] += len(batch.column(0)[i].as_buffer()) // (4 * width)
                    continue
                x = _number(batch.column(0), i, width, np.int32).astype(np.int64)
                own = nearest(x, at[several])[0]
                for k, c in enumerate(several):
                    totals[c] += x[own == k].sum(0)
                counts[several] += np.bincount(own, minlength=len(several))
        numbers = np.concatenate([counts[:, None], totals], 1)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(at), dtype=np.int32), width + 1)), pa.array(np.tile(np.arange(width + 1, dtype=np.int32), len(at))),
            pa.array(numbers.reshape(-1))], ["c", "j", "x"])

    sums = blocks.select("vectors", "least", "most", "total").mapInArrow(run, "c int, j int, x long")
    found = np.zeros((len(at), width + 1), object)
    for r in sums.groupBy("c", "j").agg(F.sum("x").alias("x")).collect():  # a row per centroid and component
        found[r.c, r.j] = r.x
    return np.array([[s // row[0] for s in row[1:]] if row[0] else old for row, old in zip(found, at.tolist())], np.int64)


def centroid_digest(centroid: list[int]) -> str:
    """Lower-case hexadecimal sha256 of the components, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
