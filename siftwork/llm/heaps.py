"""Centroid clustering with heap-ordered bounds.

A vector that was compared with all centroids knows its gap: how much farther the second nearest is than the
nearest. Its cluster's drift is what its own centroid has moved, plus the most that another one has; while the
drift since that comparison is less than the gap, the nearest centroid cannot have changed. A vector enters its
cluster's heap with the key gap + drift so far, so the vectors to look at again are those whose key the drift
has passed: the top of the heap. Only these are popped, compared with all centroids and put back.

The heaps are stored as sorted runs. Each round writes the vectors that it compared as one table, ordered by
cluster and key within its files, so that reading the tops skips pages by their statistics. Drift only grows, so
a vector is in the heap exactly while its key is above the drift: runs are never rewritten, and a popped vector
is out of its old run by itself. What one round leaves behind is a stored table; lost executors cost a re-read.

Vectors never cross the network: each task sums what changed per cluster, and per cluster and component one number is
added up. The driver holds the centroids, their sums and drifts, all bounded by the number of clusters.

Components are whole numbers (floor of a scaled component), so sums, means and distances are exact; keys are
floats with a margin far above their error. Ties go to the smaller centroid; a vector as near to two centroids
has no gap and is compared again whenever one of them may have moved.

Vectors with another number of components, or with a null, NaN or infinite one, are left out, as are null vectors. Repeated rows
count each time; a null id hashes as an empty string. Of seeds with equal hashes the smaller id goes first. With
fewer vectors than clusters each vector is a seed; an empty table gives no rows. A component beyond 2^27 after
scaling ends the job, since squared distances would not fit a long. The input may have any columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.ship import durable, packed, ship

CLUSTERS = 40
ROUNDS = 5
DIMS = 64
SCALE = 256
SEED = "2:"
MOST = 1 << 27
#: Components up to this give distances that floats hold exactly.
EXACT = 1 << 21
#: Vectors compared at once.
BLOCK = 8192


def whole_rows(dims: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, vector as 32-bit whole numbers) of (key, list) for the lists that count."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dims), False)
            held = batch.filter(fits)
            flat = held.column(1).flatten().cast(pa.float64())
            values = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)  # null is NaN
            good = np.isfinite(values).all(axis=1)
            whole = np.floor(values[good] * scale)
            if len(whole) and np.abs(whole).max() > MOST:
                raise ValueError(f"a component beyond {MOST // scale} has no exact squared distances")
            yield pa.RecordBatch.from_arrays(
                [held.column(0).filter(pa.array(good)), as_binary(whole)], names=["key", "v"]
            )

    return rows


def as_binary(vectors: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(vectors, dtype="<i4")
    bounds = np.arange(len(raw) + 1, dtype=np.int32) * (4 * raw.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw.tobytes())])


def as_vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of 64-bit whole numbers."""
    if not len(column):
        return np.empty((0, dims), dtype=np.int64)
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]
    return raw.view("<i4").reshape(-1, dims).astype(np.int64)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centroid."""
    largest = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    if largest <= EXACT:
        x, c = vectors.astype(np.float64), centroids.astype(np.float64)
        found = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
        return found.astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def compared_rows(
    centroids: np.ndarray, drift: np.ndarray
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, v, cluster, bar, was) of (key, v, was): nearest centroid, and the drift up to which it surely stays so."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                found = distances(as_vectors(batch.column(1), centroids.shape[1]), centroids)
                cluster = found.argmin(axis=1)
                nearest = found[np.arange(len(found)), cluster]
                found[np.arange(len(found)), cluster] = np.iinfo(np.int64).max
                second = np.sqrt(found.min(axis=1)) if len(centroids) > 1 else np.full(len(found), np.inf)
                gap = second - np.sqrt(nearest)
                with np.errstate(invalid="ignore"):
                    gap -= np.where(np.isinf(second), 0, 1e-9 * (1 + second))
                now = drift[cluster]
                bar = np.maximum(now + gap, np.nextafter(now, np.inf))  # above the drift: in the heap
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(bar), batch.column(2)],
                    names=["key", "v", "cluster", "bar", "was"],
                )

    return rows


def change_rows(dims: int, clusters: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task adds to each cluster's components and count, and takes away: (cluster, at, change) of (v, cluster, was)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((clusters, dims + 1), dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                vectors = as_vectors(batch.column(0), dims)
                vectors = np.concatenate([vectors, np.ones((len(vectors), 1), dtype=np.int64)], axis=1)
                now = batch.column(1).to_numpy()
                was = batch.column(2).fill_null(-1).to_numpy()
                for c in np.unique(now).tolist():
                    total[c] += vectors[now == c].sum(axis=0)
                for c in np.unique(was[was >= 0]).tolist():
                    total[c] -= vectors[was == c].sum(axis=0)
        cluster, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[cluster, place])],
            names=["cluster", "at", "change"],
        )

    return rows


def distance_rows(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, cluster, distance) of (key, v, cluster)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = centroids[batch.column(2).to_numpy()]
            found = ((as_vectors(batch.column(1), centroids.shape[1]) - own) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found)], names=["key", "cluster", "distance"]
            )

    return rows


def doubles(values: np.ndarray) -> Column:
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")


def between(low: np.ndarray | None, high: np.ndarray | None) -> Column:
    """Rows whose key lies above one drift of their cluster and not above another.

    The bounds over all clusters come first: those can be read off the statistics of a page.
    """
    own, test = F.col("bar"), F.lit(True)
    if low is not None:
        test &= (own > float(low.min())) & (own > F.get(doubles(low), F.col("cluster")))
    if high is not None:
        test &= (own <= float(high.max())) & (own <= F.get(doubles(high), F.col("cluster")))
    return test


@dataclass
class Heaps:
    """Centroids, the runs of their heaps, and what the runs have to be read against."""

    centroids: np.ndarray
    drift: np.ndarray
    sums: list[list[int]]  # of components, and the count last; exact
    runs: list[DataFrame]

    def insert(self, rows: DataFrame) -> None:
        """Compare vectors with all centroids and store them as one run; sums follow."""
        key = rows.schema["key"].dataType.simpleString()
        schema = f"key {key}, v binary, cluster int, bar double, was int"
        found = rows.mapInArrow(compared_rows(self.centroids, self.drift), schema)
        run = packed(found.sortWithinPartitions("cluster", "bar"), "heaps")
        self.runs.append(run)
        clusters, dims = self.centroids.shape
        moved = run.where(F.col("was").isNull() | (F.col("was") != F.col("cluster"))).select("v", "cluster", "was")
        changes = moved.mapInArrow(change_rows(dims, clusters), "cluster int, at int, change bigint")
        changes = changes.groupBy("cluster", "at").agg(F.sum(F.col("change").cast("decimal(38,0)")).alias("change"))
        for cluster, at, change in changes.collect():  # at most clusters x (components + 1) rows
            self.sums[cluster][at] += int(change)

    def step(self) -> None:
        """Means, their drift, and the vectors that it uncovers."""
        means = self.centroids.copy()
        for c, (*total, count) in enumerate(self.sums):
            if count:
                means[c] = [t // count for t in total]
        moved = np.sqrt(((means - self.centroids).astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
        others = np.array([max(np.delete(moved, c), default=0.0) for c in range(len(moved))])
        before, self.drift, self.centroids = self.drift, self.drift + moved + others, means
        popped = [run.where(between(before, self.drift)) for run in self.runs]
        rows = popped[0]
        for more in popped[1:]:
            rows = rows.union(more)
        self.insert(rows.select("key", "v", F.col("cluster").alias("was")))

    def held(self) -> DataFrame:
        """All vectors, each from the run it is in."""
        rows = self.runs[0].where(between(self.drift, None))
        for run in self.runs[1:]:
            rows = rows.union(run.where(between(self.drift, None)))
        return rows.select("key", "v", "cluster")


def grow(
    vectors: DataFrame, clusters: int, rounds: int, dims: int, scale: int, key: str, vector: str
) -> Heaps | None:
    """Assign and move `rounds` times, and assign once more; None without vectors."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    kind = rows.schema["key"].dataType.simpleString()
    rows = rows.mapInArrow(whole_rows(dims, scale), f"key {kind}, v binary")
    order = F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    seeds = rows.orderBy(order, "key", "v").limit(clusters).collect()
    if not seeds:
        return None
    centroids = np.stack([np.frombuffer(s.v, dtype="<i4") for s in seeds]).astype(np.int64)
    sums = [[0] * (dims + 1) for _ in seeds]
    state = Heaps(centroids, np.zeros(len(seeds)), sums, [])
    state.insert(rows.select("key", "v", F.lit(None).cast("int").alias("was")))
    for _ in range(rounds):
        state.step()
    return state


def cluster(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    scale: int = SCALE,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Each vector's key, cluster, squared distance to its centroid, the cluster's and the whole inertia, and the centroid."""
    kind = vectors.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    state = grow(vectors, clusters, rounds, dims, scale, key, vector)
    if state is None:
        schema = f"key {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
        return vectors.sparkSession.createDataFrame([], schema)
    schema = f"key {kind}, cluster int, distance bigint"
    placed = durable(state.held().mapInArrow(distance_rows(state.centroids), schema), "placed")
    inertia = dict(placed.groupBy("cluster").agg(F.sum("distance")).collect())  # one row per cluster
    each = F.expr(f"array({', '.join(f'{inertia.get(c, 0)}L' for c in range(len(state.centroids)))})")
    listed = (f"array({', '.join(f'{x}L' for x in c)})" for c in state.centroids.tolist())
    centroids = F.expr(f"array({', '.join(listed)})")
    return placed.select(
        "key",
        "cluster",
        "distance",
        F.get(each, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"),
        F.get(centroids, F.col("cluster")).alias("centroid"),
    )
