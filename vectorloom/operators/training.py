"""What an index learns from its corpus: parameters, a sample, axes, cluster centres and closure radii."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.operators.exact import matrix
from vectorloom.operators.quantizers import kmeans, nearest, principal_axes

SAMPLE = 20_000
CLOSURE = 0.15


def _pow2(x: float) -> int:
    return 1 << max(0, round(np.log2(max(1.0, x))))


@dataclass
class Parameters:
    """Sizes of the tree; zeros are resolved from the number of rows."""

    leaf_capacity: int = 5000
    k_root: int = 0
    k_top: int = 0
    depth: int = 0
    pca_dims: int | None = None

    def resolved(self, rows: int, dim: int) -> Parameters:
        k_root = self.k_root or int(np.clip(_pow2(rows / self.leaf_capacity / 2), 4, 131072))
        depth = self.depth or (3 if k_root > 2048 else 2)
        k_top = self.k_top or (int(np.clip(_pow2(max(16, k_root / 256)), 16, 512)) if depth == 3 else 0)
        leaves = -(-rows // self.leaf_capacity)
        if leaves <= k_root and not self.depth and not self.k_root:
            depth = 1
        return Parameters(self.leaf_capacity, k_root, k_top, depth, min(dim, 32) if self.pca_dims is None else min(self.pca_dims, dim))


def sample(base: DataFrame, n: int = SAMPLE, seed: int = 42) -> np.ndarray:
    """The vectors of the n rows with the least hash of their id: the same on every run and partitioning."""
    rows = base.select("row_id", "embedding").orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").limit(n).select("embedding").toArrow()
    column = rows.column(0).combine_chunks()
    return matrix(column, len(column[0])) if len(column) else np.empty((0, 0))


def stride_sample(base: DataFrame, stride: int) -> DataFrame:
    return base.where(F.pmod("row_id", F.lit(stride)) == 0)


@dataclass
class Projection:
    mean: np.ndarray
    axes: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes if self.axes.size else x - self.mean


def learn_projection(x: np.ndarray, dims: int) -> Projection:
    """Centred principal axes; dims 0 keeps the space as it is."""
    return Projection(x.mean(0), principal_axes(x, dims) if dims else np.empty((0, 0)))


def first_centres(p: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means on the projected sample from evenly picked rows."""
    k = min(k, len(p))
    return kmeans(p, k, rounds, start=p[np.arange(k) * len(p) // k])


def refined(base: DataFrame, projection: Projection, centres: np.ndarray, passes: int = 10, probe: np.ndarray | None = None) -> np.ndarray:
    """Lloyd passes over all rows. A pass sends one partial sum a task and cluster; sums are added in cluster and task
    order and the passes end once fewer than a hundredth of the probe rows change their cluster."""
    spark = base.sparkSession
    dim = projection.mean.shape[0]
    before = nearest(probe, centres) if probe is not None and len(probe) else None
    for _ in range(passes):
        shared = spark.sparkContext.broadcast((projection, centres))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            project, c = shared.value
            n, s = np.zeros(len(c), np.int64), np.zeros_like(c)
            for batch in batches:
                p = project(matrix(batch.column(0), dim))
                a = nearest(p, c)
                n += np.bincount(a, minlength=len(c))
                np.add.at(s, a, p)
            own = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), TaskContext.get().partitionId()), pa.int32()), pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(s[own].tolist(), pa.list_(pa.float64()))], ["part", "cluster", "n", "s"])

        partial = base.select("embedding").mapInArrow(run, "part int, cluster int, n long, s array<double>")
        # added on the executors: one row a cluster comes back
        totals = partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("part", "s"))).alias("parts"))
        added = F.aggregate("parts", F.array_repeat(F.lit(0.0), centres.shape[1]), lambda t, x: F.zip_with(t, x["s"], lambda a, b: a + b))
        new = centres.copy()
        full = np.zeros(len(centres), bool)
        largest = (0, 0)
        for r in totals.select("cluster", "n", added.alias("s")).collect():
            new[r.cluster] = np.array(r.s) / r.n
            full[r.cluster] = True
            largest = max(largest, (r.n, r.cluster))
        new[~full] = new[largest[1]]
        centres = new
        shared.unpersist()
        if before is not None:
            now = nearest(probe, centres)
            if (now != before).mean() < 0.01:
                break
            before = now
    return centres


def closure_radii(p: np.ndarray, centres: np.ndarray, factor: float = CLOSURE) -> np.ndarray:
    """Per cluster, how much farther than its nearest centre a row may lie and still be kept there as well."""
    if len(centres) < 2 or not len(p):
        return np.zeros(len(centres))
    d = np.sqrt(np.maximum(((p[:, None] - centres) ** 2).sum(2), 0)) if len(p) * len(centres) < 2_000_000 else np.sqrt(np.maximum((p * p).sum(1)[:, None] - 2 * p @ centres.T + (centres * centres).sum(1), 0))
    two = np.partition(d, 1, axis=1)[:, :2]
    gap, a = two[:, 1] - two[:, 0], d.argmin(1)
    mean = np.bincount(a, gap, len(centres)) / np.maximum(np.bincount(a, minlength=len(centres)), 1)
    return factor * np.where(np.bincount(a, minlength=len(centres)) > 0, mean, gap.mean())


def assigned(base: DataFrame, projection: Projection, centres: np.ndarray, radii: np.ndarray) -> DataFrame:
    """The rows with their cluster_id, one a cluster within the closure radius of the nearest."""
    shared = base.sparkSession.sparkContext.broadcast((projection, centres, radii))
    dim = projection.mean.shape[0]

    @F.arrow_udf("array<int>")
    def clusters(v: pa.Array) -> pa.Array:
        project, c, eps = shared.value
        p = project(matrix(v, dim))
        d = np.sqrt(np.maximum((p * p).sum(1)[:, None] - 2 * p @ c.T + (c * c).sum(1), 0))
        near = d - d.min(1, keepdims=True) <= eps
        near[np.arange(len(d)), d.argmin(1)] = True
        rows, which = np.nonzero(near)
        return pa.ListArray.from_arrays(np.append(0, np.cumsum(np.bincount(rows, minlength=len(d)))).astype(np.int32), pa.array(which.astype(np.int32)))

    return base.withColumn("cluster_id", F.explode(clusters("embedding")))


def closure_by_distance(scored: DataFrame, radius: float) -> DataFrame:
    """The same rule over (row_id, cluster_id, dist) rows: every cluster within radius of the row's nearest."""
    from pyspark.sql import Window

    least = F.min("dist").over(Window.partitionBy("row_id"))
    return scored.withColumn("least", least).where(F.col("dist") - F.col("least") <= radius).drop("least")
