"""Centroid clustering with heap-ordered bounds, exact in integers.

A vector's gap is the distance to the second nearest centroid less the distance
to its own. When centroids move, the gap of a vector of cluster c shrinks by no
more than the way of c and the longest way of another centroid; these add up to
the drift of c. So a vector is filed under `due`: its gap plus the drift of its
cluster at that time. While the drift of its cluster stays under it, its cluster
cannot change, and it is not looked at. Each cluster's vectors are a heap by
`due`; what a round pops are those that the drift has come up to.

The heap of a round is a table sorted by cluster and due. Popping is a filter of
due between the last drift and the new one, which reaches the scan and reads the
pages that hold such rows. Popped vectors are measured against all centroids and
written, with their new due, as the next table; older tables stay as they are,
for a row whose due is under the drift has been popped and is not read again.
Sums of clusters change by the vectors that moved. Only centroids, drifts and
sums (k rows) are on the driver.

Bounds are floating-point numbers with a margin far over their error; a vector
that is nearly as far from two centroids always falls within it, so ties and all
distances are decided by exact integers.

Rows: vectors of another length, with a null or a number that is not finite, and
with components whose 64-fold is over 2^27 (their distances need not fit a
long), are left out. Null ids are clustered and never start a centroid; repeated
rows are vectors of their own, and repeated ids can start several centroids. With
fewer vectors than centroids there are fewer centroids. Empty tables give empty
results; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.scratch import scratch_path, written

CENTROIDS = 16
DIMENSIONS = 64
SCALE = 64
ROUNDS = 3
SEED = "1"
MOST = 1 << 27
#: Share of the distances by which a bound is widened; doubles are exact to 1e-15 of them.
MARGIN = 1e-9
_ROWS = 8_192


def whole_vectors(table: DataFrame, key: str = "vec_id", column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of the right length and finite components, each component x as floor(scale * x)."""
    x = F.col(column)
    ok = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * scale <= MOST))
    return table.where(F.coalesce(ok, F.lit(False))).select(F.col(key).alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The k vectors whose `seed:<vec_id>` has the smallest SHA-256, in its order; of one id in the order of their components."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.where("vec_id is not null").select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dimensions)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, a row per vector and a column per centroid; exact."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for c, centroid in enumerate(centroids):
        away = vectors - centroid
        np.einsum("ij,ij->i", away, away, out=out[:, c])
    return out


@dataclass(frozen=True)
class Heap:
    """A table of one round: rows (vec_id, v, before, cluster, due) sorted by cluster and due. before: the cluster until then, -1 for none."""

    rows: DataFrame
    round: int


def _measured(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray, vec_id: str) -> DataFrame:
    """Rows (vec_id, v, before) with their cluster, the nearest centroid (of equal ones the first), and due."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                v = part.column(part.schema.get_field_index("v"))
                found = distances(_matrix(v, centroids.shape[1]), centroids)
                cluster = found.argmin(1)
                own = np.sqrt(np.take_along_axis(found, cluster[:, None], 1)[:, 0])
                np.put_along_axis(found, cluster[:, None], np.iinfo(np.int64).max, 1)
                other = np.sqrt(found.min(1)) if len(centroids) > 1 else np.full(len(own), np.inf)
                due = drift[cluster] + (other - own) - np.where(np.isinf(other), 0, (other + own + 1) * MARGIN)
                columns = [part.column(part.schema.get_field_index("vec_id")), v, part.column(part.schema.get_field_index("before")), pa.array(cluster, pa.int32()), pa.array(due)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "before", "cluster", "due"])

    return rows.select("vec_id", "v", "before").mapInArrow(run, f"vec_id {vec_id}, v array<int>, before int, cluster int, due double")


def _heap(rows: DataFrame, number: int) -> Heap:
    path = scratch_path(rows.sparkSession, f"heap{number}")
    rows.sortWithinPartitions("cluster", "due").write.parquet(path)
    return Heap(rows.sparkSession.read.schema(rows.schema).parquet(path), number)


def _due(low: np.ndarray | None, high: np.ndarray | None) -> Column:
    """Rows with low < due <= high of their cluster."""
    found = F.lit(False)
    for c in range(len(low if high is None else high)):
        inside = F.col("cluster") == c
        if low is not None:
            inside = inside & (F.col("due") > float(low[c]))
        if high is not None:
            inside = inside & (F.col("due") <= float(high[c]))
        found = found | inside
    return found


def popped(heaps: list[Heap], low: np.ndarray, high: np.ndarray) -> DataFrame:
    """Rows of the heaps that come due as the drift goes from `low` to `high`; of the newest heap also those that were due when they were filed."""
    parts = [h.rows.where(_due(None if h is heaps[-1] else low, high)) for h in heaps]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def standing(heaps: list[Heap], drift: np.ndarray) -> DataFrame:
    """The row of every vector that counts: not yet due in an older heap, or in the newest."""
    out = heaps[-1].rows
    for h in heaps[:-1]:
        out = out.unionByName(h.rows.where(_due(drift, None)))
    return out


def _moved_sums(heap: Heap, k: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) by which the vectors that moved in a heap change the clusters; exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(0), dimensions)
            before, after = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            counts, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
            for c in range(k):
                counts[c] = (after == c).sum() - (before == c).sum()
                sums[c] = v[after == c].sum(0) - v[before == c].sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(counts), pa.ListArray.from_arrays(np.arange(k + 1, dtype=np.int32) * dimensions, pa.array(sums.reshape(-1)))], names=["c", "n", "s"])

    parts = heap.rows.where("before <> cluster").select("v", "before", "cluster").mapInArrow(run, "c int, n bigint, s array<bigint>")
    each = parts.select("c", F.posexplode(F.concat(F.array("n"), "s")).alias("at", "x")).groupBy("c", "at").agg(F.sum("x").alias("x"))
    out = np.zeros((k, dimensions + 1), np.int64)
    for r in each.collect():
        out[r.c, r.at] = r.x
    return out[:, 0], out[:, 1:]


@dataclass(frozen=True)
class Clustering:
    """rows: (vec_id, v, cluster, distance) of every vector; centroids; measured: vectors measured in each round."""

    rows: DataFrame
    centroids: np.ndarray


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> Clustering:
    """Assign `vectors` (vec_id, v) to centroids, move those `rounds` times to the floor of their vectors' means, and assign once more."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["vec_id"]
    vectors = written(vectors)
    centroids = first_centroids(vectors, k, seed)
    schema = f"vec_id {kind}, v array<int>, cluster int, distance bigint"
    if not len(centroids):
        return Clustering(spark.createDataFrame([], schema), centroids)
    k, dimensions = centroids.shape
    drift = np.zeros(k)
    heaps = [_heap(_measured(vectors.withColumn("before", F.lit(-1)), centroids, drift, kind), 0)]
    counts, sums = _moved_sums(heaps[0], k, dimensions)
    for number in range(1, rounds + 1):
        moved = np.where(counts[:, None] > 0, np.floor_divide(sums, np.maximum(counts, 1)[:, None]), centroids)
        way = np.sqrt(((moved - centroids) ** 2).sum(1)) * (1 + MARGIN)
        others = np.array([np.delete(way, c).max(initial=0.0) for c in range(k)])
        before, drift, centroids = drift, drift + way + others, moved
        due = popped(heaps, before, drift).select("vec_id", "v", F.col("cluster").alias("before"))
        heaps.append(_heap(_measured(due, centroids, drift, kind), number))
        if number < rounds:
            more = _moved_sums(heaps[-1], k, dimensions)
            counts, sums = counts + more[0], sums + more[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(batch.schema.get_field_index("cluster"))
            v = batch.column(batch.schema.get_field_index("v"))
            away = _matrix(v, dimensions) - centroids[of.to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("vec_id")), v, of, pa.array(np.einsum("ij,ij->i", away, away))], names=["vec_id", "v", "cluster", "distance"])

    return Clustering(standing(heaps, drift).select("vec_id", "v", "cluster").mapInArrow(run, schema), centroids)


def with_inertia(found: Clustering) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector; the last is of the centroid's components, comma-joined."""
    spark: SparkSession = found.rows.sparkSession
    rows = written(found.rows.select("vec_id", "cluster", "distance"))
    names = spark.createDataFrame([(c, ",".join(map(str, x))) for c, x in enumerate(found.centroids.tolist())], "cluster int, components string")
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # k rows
    every = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    clusters = names.join(F.broadcast(sums), "cluster").crossJoin(F.broadcast(every)).select("cluster", "cluster_inertia", "inertia", F.sha2(F.col("components").cast("binary"), 256).alias("centroid_sha256"))
    return rows.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
