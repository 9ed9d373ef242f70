"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample of the vectors (``SAMPLE``): centred vectors are projected on their principal
axes and turned so that their signs lose least (iterative quantisation), which balances the bits. Several rotations,
each from another start, give a long binary code. The code is cut into tables of as many bits as the number of vectors
asks for (none for so few that they can be compared with each other); two vectors are candidates if they agree on all bits of a table, and how many tables are needed is measured
on sample vectors turned by just the threshold's angle. Candidates are then ranked by the cosine of the original
vectors in double precision.

Equal vectors are treated as one with a weight. A bucket beyond ``CELL`` rows is split into blocks, and each pair of
blocks becomes a cell of its own, so no task gets an unbounded bucket and no pair is lost. A pair counts in the first
table on which it agrees, so it counts once; pairs themselves are never written, only sums a vector and the edges of
a spanning forest a cell.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id,
link with nothing (component_id is their own id); vectors of different lengths never link; repeated rows count as one
vector and are returned as often as they come; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import checkpointed, maybe_broadcast, whole_groups
from vectorloom.llm.graph import components

THRESHOLD = 0.9
SAMPLE = 10_000
#: Share of pairs at just the threshold that the tables must bring together; closer pairs fare better.
RECALL = 0.975
#: Rows that a bucket holds on average, and rows of a cell at most. Each table carries a copy of the vectors, so large
#: buckets, which need fewer tables, are paid for by comparisons (one matrix product a bucket) instead of disk.
MEAN_BUCKET, CELL = 256, 3000
#: Tables in a row without a further pair, after which they get a bit less.
IDLE = 60


@dataclass
class Coder:
    mean: np.ndarray
    #: dimension x bits: principal axes times rotations
    planes: np.ndarray
    bits: int
    tables: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Signs, one row a vector and one column a bit of the tables in use."""
        return (x - self.mean) @ self.planes[:, : self.bits * self.tables] >= 0


def learn_rotation(v: np.ndarray, seed: int, rounds: int = 25) -> np.ndarray:
    """Iterative quantisation: alternates between the signs of the turned vectors and the turn that fits them best."""
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1], v.shape[1])))
    for _ in range(rounds):
        b = np.where(v @ r >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(b.T @ v)
        r = (left @ right).T
    return r


def fit(x: np.ndarray, n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Coder:
    """x: unit vectors of the sample; n: how many vectors there are in all."""
    bits = int(np.clip(np.ceil(np.log2(max(1, n) / MEAN_BUCKET)), 0, 30))
    mean = x.mean(0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1]
    v = centred @ axes
    rng = np.random.default_rng(7)
    probe = x[rng.permutation(len(x))[:1500]]
    noise = rng.normal(size=probe.shape)
    noise -= (noise * probe).sum(1, keepdims=True) * probe
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    turned = threshold * probe + np.sqrt(1 - threshold**2) * noise
    planes = np.empty((x.shape[1], 0))
    tables, hit, idle = 0, np.zeros(len(probe), bool), 0
    while tables == 0 or hit.mean() < recall:
        if idle > IDLE:  # vectors of few dimensions: larger buckets instead, at last one for all
            bits, tables, idle = bits - 1, 0, 0
            hit[:] = False
        if planes.shape[1] < bits * (tables + 1):
            planes = np.hstack([planes, axes @ learn_rotation(v, planes.shape[1])])
            continue
        part = planes[:, bits * tables : bits * (tables + 1)]
        new = (((probe - mean) @ part >= 0) == ((turned - mean) @ part >= 0)).all(1) & ~hit
        idle = 0 if new.any() else idle + 1
        hit |= new
        tables += 1
    return Coder(mean, planes[:, : bits * tables], bits, tables)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _emit(distinct: DataFrame, coder: Coder, dim: int) -> DataFrame:
    """One row a vector and table: bucket key, eid, weight, vector, packed code."""
    shared = distinct.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                c = shared.value
                signs = c.codes(_unit(_matrix(part.column(2), dim)))
                packed = pa.array([r.tobytes() for r in np.packbits(signs, axis=1)], pa.binary())
                keys = signs.reshape(len(signs), c.tables, c.bits) @ (1 << np.arange(c.bits, dtype=np.int64)) + (np.arange(c.tables, dtype=np.int64) << 32)
                rows = pa.array(np.repeat(np.arange(len(signs)), c.tables))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(part.column(i).take(rows) for i in range(3)), packed.take(rows)], ["key", "eid", "weight", "vector", "code"])

    return distinct.select("eid", "weight", "vector").mapInArrow(run, "key long, eid long, weight long, vector array<float>, code binary")


def _celled(rows: DataFrame) -> DataFrame:
    """Adds the cell and the side within it. Only rows of buckets beyond CELL are repeated, once a pair of blocks."""
    hot = checkpointed(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select("key", F.ceil(2 * F.col("n") / CELL).cast("int").alias("blocks")))
    n = hot.count()
    if n == 0:
        return rows.withColumns({"cell": F.col("key"), "side": F.lit(0)})
    joined = rows.join(maybe_broadcast(hot, n, 16), "key", "left").withColumn("block", F.pmod(F.xxhash64("eid", F.lit("block")), F.col("blocks")).cast("int"))
    cold = joined.where("blocks IS NULL").withColumns({"cell": F.col("key"), "side": F.lit(0)})
    split = joined.where("blocks IS NOT NULL").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # side 0: both blocks are one; 1 and 2: only pairs across count
    split = split.withColumns({"cell": F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")), "side": F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)})
    return cold.drop("blocks", "block").unionByName(split.drop("blocks", "block", "other"))


def _compare(cells: DataFrame, coder: Coder, dim: int, threshold: float) -> DataFrame:
    """Rows (u, v, n): with v null, that u has links of weight n in this cell; else an edge of a spanning forest."""
    bits, tables = coder.bits, coder.tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches):
            cell, key, eid, weight, side = (chunk.column(c).to_numpy() for c in ("cell", "key", "eid", "weight", "side"))
            edges = np.flatnonzero(np.diff(cell)) + 1
            begin, end = np.append(0, edges), np.append(edges, len(cell))
            many = end - begin > 1
            if not many.any():
                continue
            x = _unit(_matrix(chunk.column("vector"), dim))
            codes = chunk.column("code").to_pylist()
            links = np.zeros(len(cell), np.int64)
            found_u, found_v = [], []
            for a, b in zip(begin[many].tolist(), end[many].tolist()):
                parent = {}

                def root(i):
                    while parent.setdefault(i, i) != i:
                        parent[i] = parent[parent[i]]
                        i = parent[i]
                    return i

                for lo in range(a, b, 1024):
                    hi = min(b, lo + 1024)
                    close = x[lo:hi] @ x[a:b].T >= threshold - 1e-9
                    i, j = np.nonzero(close)
                    i, j = i + lo, j + a
                    keep = i < j
                    i, j = i[keep], j[keep]
                    if not len(i):
                        continue
                    i, j = _exact(x, i, j, threshold)
                    # the same bucket: split buckets are cut by hash of the key, so keys are compared too
                    keep = (key[i] == key[j]) & (eid[i] != eid[j]) & ((side[i] == 0) | (side[i] != side[j]))
                    i, j = i[keep], j[keep]
                    if not len(i):
                        continue
                    if bits:  # else there is one table
                        rows = np.unique(np.concatenate([i, j]))
                        signs = np.unpackbits(np.frombuffer(b"".join([codes[r] for r in rows]), np.uint8).reshape(len(rows), -1), axis=1)[:, : bits * tables].reshape(len(rows), tables, bits)
                        pi, pj = rows.searchsorted(i), rows.searchsorted(j)
                        first = np.empty(len(i), np.int64)
                        for s in range(0, len(i), 4096):
                            first[s : s + 4096] = (signs[pi[s : s + 4096]] == signs[pj[s : s + 4096]]).all(2).argmax(1)
                        keep = first == key[i] >> 32
                        i, j = i[keep], j[keep]
                    np.add.at(links, i, weight[j])
                    np.add.at(links, j, weight[i])
                    for p, q in zip(i.tolist(), j.tolist()):
                        p, q = root(p), root(q)
                        if p != q:
                            parent[max(p, q)] = min(p, q)
                for i in list(parent):
                    if (r := root(i)) != i:
                        found_u.append(eid[i])
                        found_v.append(eid[r])
            own = np.flatnonzero(links)
            ids, inverse = np.unique(eid[own], return_inverse=True)
            u = np.concatenate([ids, np.array(found_u, np.int64)])
            v = pa.array([None] * len(ids) + [int(q) for q in found_v], pa.int64())
            n = np.concatenate([np.bincount(inverse, links[own], len(ids)).astype(np.int64), np.zeros(len(found_u), np.int64)])
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), v, pa.array(n)], ["u", "v", "n"])

    ordered = cells.select("cell", "key", "eid", "weight", "side", "vector", "code").repartition("cell").sortWithinPartitions("cell")
    return ordered.mapInArrow(run, "u long, v long, n long")


def _exact(x: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at or above the threshold by a sum that doesn't depend on the shape of the block."""
    keep = np.empty(len(i), bool)
    for s in range(0, len(i), 8192):
        keep[s : s + 8192] = (x[i[s : s + 8192]] * x[j[s : s + 8192]]).sum(1) >= threshold
    return i[keep], j[keep]


def _of_one_length(distinct: DataFrame, n: int, dim: int, threshold: float) -> DataFrame:
    sample = distinct.orderBy(F.xxhash64("eid", F.lit("sample")), "eid").select("vector").limit(SAMPLE).toArrow()
    coder = fit(_unit(_matrix(sample.column(0), dim)), n, threshold)
    return _compare(_celled(_emit(distinct, coder, dim)), coder, dim, threshold)


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    v = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), v.cast("array<float>")).alias("vector"))
    source = source.withColumn("eid", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    distinct = checkpointed(source.where("eid IS NOT NULL").groupBy("eid").agg(F.first("vector").alias("vector"), F.min("vec_id").alias("least"), F.count_distinct("vec_id").alias("weight")))
    found = None
    for row in distinct.groupBy(F.size("vector").alias("dim")).count().orderBy("dim").collect():
        part = _of_one_length(distinct.where(F.size("vector") == row["dim"]), row["count"], row["dim"], threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return source.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = checkpointed(found)
    links = found.where("v IS NULL").groupBy(F.col("u").alias("eid")).agg(F.sum("n").alias("n"))
    grouped = checkpointed(components(found.where("v IS NOT NULL").select("u", "v")).withColumnRenamed("node", "eid"))
    least = grouped.join(distinct.select("eid", "least"), "eid").groupBy("component").agg(F.min("least").alias("joint"))
    known = distinct.select("eid", "least", "weight").join(links, "eid", "left").join(grouped.join(least, "component").select("eid", "joint"), "eid", "left")
    known = known.select("eid", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("joint", "least").alias("joint"))
    out = source.select("vec_id", "eid").join(known, "eid", "left")
    component = F.coalesce("joint", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
