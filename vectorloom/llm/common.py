"""Helpers that the operators share: reading, batching, scratch tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one call of a Python kernel gets at most (a single longer text forms a batch alone).
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts an Arrow batch so that no piece holds much more than so many bytes of the named column."""
    if not batch.num_rows:
        return
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        stop = max(start + 1, min(start + BATCH_ROWS, int(np.searchsorted(size, base + most, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


_KEPT: dict = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task: one thing at a time, so that stages of another kind free it."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Frees what an earlier stage kept in this worker process."""
    _KEPT.clear()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a thousand rows unless the session says otherwise: texts are long, and batches are held on both
    sides of the pipe."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def map_arrow(df: DataFrame, column: str, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow over bounded pieces; the kernel returns a batch of ``schema`` or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, column):
                out = kernel(piece)
                if out is not None and out.num_rows:
                    yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; set here only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        found = tempfile.mkdtemp(prefix="vectorloom-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """A broadcast hint only if the counted rows, with what a hash table takes a row, are known to fit under the limit; else
    a shuffled join."""
    return F.broadcast(df) if rows * (row_bytes + 64) <= limit else df


def whole_groups(batches: Iterator[pa.RecordBatch], key: int = 0, rows: int = 4096) -> Iterator[pa.Table]:
    """Of batches sorted by a column without nulls: tables of some rows or more in which no group is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int((k != k[-1]).sum()) if k[0] != k[-1] else 0
        if held and held[-1].column(key)[-1].as_py() != k[0] and sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
        if cut and sum(b.num_rows for b in held) + cut >= rows:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
