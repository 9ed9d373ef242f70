"""Vector file formats: readers as DataFrames in parallel ranges, writers, and label joins by position."""

from __future__ import annotations

import glob as glob_lib
import json
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vectorloom.functions.predicates import kind_of
from vectorloom.functions.vectors import normalized

_BIN_TYPES = {".fbin": "<f4", ".ibin": "<i4", ".bbin": "u1", ".u8bin": "u1", ".i8bin": "i1"}
_VEC_TYPES = {".fvecs": "<f4", ".ivecs": "<i4", ".bvecs": "u1"}
ROWS_PER_TASK = 100_000


class VectorRange(InputPartition):
    def __init__(self, path: str, first: int, last: int, base: int):
        self.path, self.first, self.last, self.base = path, first, last, base


class VectorReader(DataSourceReader):
    """Row ranges of vector files: row_id is the position, counted on over the files in sorted order."""

    def __init__(self, options: dict):
        self.pattern, self.step = options["path"], int(options.get("rowsPerTask", ROWS_PER_TASK))

    def partitions(self):
        out, base, dims = [], 0, set()
        for path in sorted(glob_lib.glob(self.pattern)) or [self.pattern]:
            n, dim, _, _ = layout(path)
            dims.add(dim)
            out += [VectorRange(path, a, min(n, a + self.step), base) for a in range(0, n, self.step)]
            base += n
        if len(dims) > 1:
            raise ValueError(f"files of different lengths {sorted(dims)}")
        return out

    def read(self, part):
        n, dim, dtype, head = layout(part.path)
        stride = dim * dtype.itemsize + (4 if head == 0 else 0)
        for a in range(part.first, part.last, 8192):
            b = min(part.last, a + 8192)
            with open(part.path, "rb") as f:
                f.seek(head + a * stride)
                raw = np.frombuffer(f.read((b - a) * stride), np.uint8).reshape(b - a, stride)
            x = np.ascontiguousarray(raw[:, stride - dim * dtype.itemsize :]).view(dtype).astype(np.float32)
            ids = np.arange(a, b, dtype=np.int64) + part.base
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(np.arange(0, x.size + 1, dim, dtype=np.int32), pa.array(x.ravel()))], ["row_id", "embedding"])


class VectorFiles(DataSource):
    """``spark.read.format("vectors").load(path)`` for the counted (fbin, ibin, bbin) and the row-wise (fvecs) formats."""

    @classmethod
    def name(cls):
        return "vectors"

    def schema(self):
        return "row_id long, embedding array<float>"

    def reader(self, schema):
        return VectorReader(self.options)


def layout(path: str) -> tuple[int, int, np.dtype, int]:
    """Rows, components, element type and header bytes of a vector file; raises where its size doesn't fit."""
    suffix, size = Path(path).suffix, Path(path).stat().st_size
    with open(path, "rb") as f:
        if suffix in _BIN_TYPES:
            n, dim = struct.unpack("<II", f.read(8))
            dtype = np.dtype(_BIN_TYPES[suffix])
            if dim < 1 or size != 8 + n * dim * dtype.itemsize:
                raise ValueError(f"{path}: size does not fit its header")
            return n, dim, dtype, 8
        if suffix in _VEC_TYPES:
            dtype = np.dtype(_VEC_TYPES[suffix])
            dim = struct.unpack("<i", f.read(4))[0] if size else 0
            stride = 4 + dim * dtype.itemsize
            if dim < 1 or size % stride:
                raise ValueError(f"{path}: size does not fit its rows")
            return size // stride, dim, dtype, 0
    raise ValueError(f"{path}: unknown vector format")


def read_vectors(spark: SparkSession, path: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """A vector file, or all that match a pattern."""
    spark.dataSource.register(VectorFiles)
    return spark.read.format("vectors").option("rowsPerTask", rows_per_task).load(path)


def write_fbin(df: DataFrame, path: str) -> int:
    """Rows in row_id order as one counted file; streamed through the driver, since the format has one header."""
    n, dim = df.count(), None
    with open(path, "wb") as f:
        f.write(struct.pack("<II", n, 0))
        for r in df.select("embedding").orderBy("row_id").select("embedding").toLocalIterator():
            x = np.asarray(r.embedding, "<f4")
            if dim not in (None, len(x)):
                raise ValueError("vectors of different lengths")
            dim = len(x)
            f.write(x.tobytes())
        f.seek(4)
        f.write(struct.pack("<I", dim or 0))
    return n


def convert_vecs(source: str, target: str) -> int:
    """fvecs, ivecs or bvecs to the counted format of the same element type."""
    n, dim, dtype, _ = layout(source)
    with open(source, "rb") as f, open(target, "wb") as g:
        g.write(struct.pack("<II", n, dim))
        for a in range(0, n, 65536):
            b = min(n, a + 65536)
            raw = np.frombuffer(f.read((b - a) * (4 + dim * dtype.itemsize)), np.uint8).reshape(b - a, -1)
            g.write(raw[:, 4:].tobytes())
    return n


def demonstration_columns(df: DataFrame) -> DataFrame:
    """Adds category (16 values), year (2015 to 2024) and score (0 to 1), which follow from row_id alone."""
    h = F.pmod(F.col("row_id") * 2654435761, F.lit(1 << 32))
    return df.withColumns({"category": F.concat(F.lit("cat_"), (h % 16).cast("string")), "year": (2015 + F.floor(h / 16) % 10).cast("int"), "score": (h / float(1 << 32)).cast("float")})


def vectors_to_parquet(spark: SparkSession, source: str, target: str, fixed: bool = False, half: bool = False) -> None:
    """A vector file as Parquet with demonstration columns; with fixed, vectors become bytes of equal length."""
    df = demonstration_columns(read_vectors(spark, source))
    (to_fixed(df, half) if fixed else df).write.parquet(target)


def to_fixed(df: DataFrame, half: bool = False, vector: str = "embedding") -> DataFrame:
    """List vectors as bytes of 32-bit, or with half 16-bit, floats."""
    width = "<f2" if half else "<f4"

    @F.arrow_udf("binary")
    def packed(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else np.asarray(x, width).tobytes() for x in v.to_pylist()], pa.binary())

    return df.withColumn(vector, packed(vector))


def database_to_fbin(database: str, table: str, column: str, target: str) -> int:
    """A DuckDB table's vector column as a counted file, in rowid order."""
    import duckdb

    with duckdb.connect(database, read_only=True) as c, open(target, "wb") as f:
        n, dim = c.execute(f'SELECT count(*), coalesce(max(len("{column}")), 0) FROM "{table}"').fetchall()[0]
        f.write(struct.pack("<II", n, dim))
        for a in range(0, n, 65536):
            for (v,) in c.execute(f'SELECT "{column}" FROM "{table}" ORDER BY rowid LIMIT 65536 OFFSET {a}').fetchall():
                if v is None or len(v) != dim:
                    raise ValueError("vectors of different lengths")
                f.write(np.asarray(v, "<f4").tobytes())
    return n


def hdf5_to_fbin(source: str, dataset: str, target: str) -> int:
    """An HDF5 matrix as a counted file; needs h5py."""
    try:
        import h5py
    except ImportError:
        raise RuntimeError("reading HDF5 needs h5py") from None
    with h5py.File(source) as h, open(target, "wb") as f:
        x = h[dataset]
        f.write(struct.pack("<II", *x.shape))
        for a in range(0, x.shape[0], 65536):
            f.write(np.asarray(x[a : a + 65536], "<f4").tobytes())
    return x.shape[0]


# --- Parquet -------------------------------------------------------------------------------------------------------


def read_parquet(spark: SparkSession, path: str, vector: str = "embedding", payload: str | None = None, half: bool = False, normalize: bool = False, strict: bool = True) -> DataFrame:
    """row_id (position), embedding, filter columns and payload of one or more Parquet files in sorted order.

    The vector column may be a list of floats, fixed-length bytes of 32-bit (or, with half, 16-bit) floats, or one
    number. Every other column is a filter column, and with strict, one that can't be filtered on is an error."""
    df = with_positions(spark.read.parquet(path))
    dtype = df.schema[vector].dataType
    if isinstance(dtype, T.BinaryType):
        width = np.dtype("<f2" if half else "<f4")

        @F.arrow_udf("array<float>")
        def decoded(v: pa.Array) -> pa.Array:
            return pa.array([None if b is None else np.frombuffer(b, width).astype("<f4").tolist() for b in v.to_pylist()], pa.list_(pa.float32()))

        df = df.withColumn(vector, decoded(vector))
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        df = df.withColumn(vector, F.array(F.col(vector).cast("float")))
    elif isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.FloatType, T.DoubleType, T.IntegerType)):
        df = df.withColumn(vector, F.col(vector).cast("array<float>"))
    else:
        raise ValueError(f"{vector} is no vector column")
    if payload:
        df = df.withColumn(payload, F.coalesce(F.col(payload).cast("binary"), F.lit(b""))).withColumnRenamed(payload, "payload")
    wrong = [f.name for f in df.schema if f.name not in (vector, "row_id", "payload") and kind_of(f.dataType) is None]
    if strict and wrong:
        raise ValueError(f"columns that can't be filtered on: {', '.join(wrong)}")
    df = df.withColumnRenamed(vector, "embedding").drop(*wrong)
    return df.withColumn("embedding", normalized(F.col("embedding"))) if normalize else df


def checked_dim(df: DataFrame) -> int:
    """The vectors' common length; empty tables, empty and ragged vectors are errors."""
    low, high = df.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if low is None or low != high or low < 1:
        raise ValueError("vectors must be there and have one length")
    return low


def with_positions(df: DataFrame) -> DataFrame:
    """Adds row_id: the row's place in its file after all rows of the files before, by name. Only a count a file is
    brought together."""
    spark = df.sparkSession
    placed = df.select("*", F.col("_metadata.file_path").alias("file__"), F.col("_metadata.row_index").alias("place__"))
    sizes = placed.groupBy("file__").agg((F.max("place__") + 1).alias("n"))
    first = sizes.select("file__", (F.sum("n").over(Window.orderBy("file__")) - F.col("n")).alias("first__"))
    return placed.join(F.broadcast(first) if sizes.count() < 100_000 else first, "file__").withColumn("row_id", F.col("first__") + F.col("place__")).drop("file__", "place__", "first__")


def positional_join(rows: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """Appends label columns, by name, to the rows with the same row_id; both sides must be equally long."""
    if rows.count() != labels.count():
        raise ValueError("labels and rows differ in number")
    return rows.join(labels.select("row_id", *columns), "row_id")


def from_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """An in-memory table; missing numbers are 0, texts empty and sets empty."""
    s = T._parse_datatype_string(schema)

    def default(t):
        return "" if isinstance(t, T.StringType) else [] if isinstance(t, T.ArrayType) else False if isinstance(t, T.BooleanType) else b"" if isinstance(t, T.BinaryType) else 0.0 if isinstance(t, (T.FloatType, T.DoubleType)) else 0

    return spark.createDataFrame([tuple(r.get(f.name, default(f.dataType)) for f in s) for r in rows], s)


# --- ground truth ---------------------------------------------------------------------------------------------------

_MAGIC = b"GTMM"


def write_truth(truth: DataFrame, path: str, metric: str = "l2") -> None:
    """(query_id, rank, row_id, dist) as a binary file: queries in order, each with the k of the first one."""
    rows = truth.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "row_id", "dist"))).alias("n")).orderBy("query_id")
    n = rows.count()
    with open(path, "wb") as f:
        k = None
        for r in rows.toLocalIterator():
            if k is None:
                k = len(r.n)
                f.write(_MAGIC + struct.pack("<IIB", n, k, 0 if metric == "l2" else 1))
            if len(r.n) != k:
                raise ValueError("queries have lists of different lengths")
            f.write(np.array([x.row_id for x in r.n], "<u4").tobytes() + np.array([x.dist for x in r.n], "<f4").tobytes())
        if k is None:
            f.write(_MAGIC + struct.pack("<IIB", 0, 0, 0 if metric == "l2" else 1))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, rank, row_id, dist); dist is null if the file holds ids only (all distances zero)."""
    with open(path, "rb") as f:
        if f.read(4) != _MAGIC:
            raise ValueError(f"{path}: no ground truth")
        n, k, _ = struct.unpack("<IIB", f.read(9))
    with_dist = False
    if n and k:
        data = np.memmap(path, np.uint8, "r", offset=13, shape=(n, 8 * k))
        with_dist = bool(any(data[a : a + 4096, 4 * k :].any() for a in range(0, n, 4096)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            part = np.stack([np.memmap(path, np.uint8, "r", offset=13 + 8 * k * int(i), shape=(8 * k,)) for i in ids])
            rows = np.ascontiguousarray(part[:, : 4 * k]).view("<u4").astype(np.int64)
            dist = np.ascontiguousarray(part[:, 4 * k :]).view("<f4").astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))), pa.array(rows.ravel()), pa.array(dist.ravel()) if with_dist else pa.nulls(rows.size, pa.float64())], ["query_id", "rank", "row_id", "dist"])

    return spark.range(n if k else 0).mapInArrow(run, "query_id long, rank int, row_id long, dist double")


def truth_from_lists(df: DataFrame, column: str = "neighbors_id") -> DataFrame:
    """(query_id, rank, row_id) of a table with one list of neighbours a query, in file order or by its query_id."""
    keyed = df if "query_id" in df.columns else with_positions(df).withColumnRenamed("row_id", "query_id")
    return keyed.select("query_id", F.posexplode(column).alias("rank", "row_id")).withColumn("rank", F.col("rank") + 1)


# --- filter sidecars, results, metrics ------------------------------------------------------------------------------

_KINDS = {0: ("<i4", "int"), 1: ("<i8", "bigint"), 2: ("<f4", "float"), 3: ("u1", "boolean")}


def write_sidecar(rows: list[dict], columns: list[tuple[str, str]], path: str) -> None:
    """Filter columns beside a vector file: types int, bigint, float, boolean, string and set."""
    codes = {"int": 0, "bigint": 1, "float": 2, "boolean": 3, "string": 4, "set": 5}
    with open(path, "wb") as f:
        f.write(b"FDAT" + struct.pack("<QI", len(rows), len(columns)))
        f.write(bytes(codes[t] for _, t in columns))
        for name, _ in columns:
            f.write(struct.pack("<H", len(name.encode())) + name.encode())
        f.write(b"\0")
        for name, t in columns:
            for r in rows:
                v = r[name]
                if t in ("string", "set"):
                    items = [v] if t == "string" else v
                    if t == "set":
                        f.write(struct.pack("<B", len(items)))
                    for s in items:
                        f.write(struct.pack("<H", len(s.encode())) + s.encode())
                else:
                    f.write(np.array([v], _KINDS[codes[t]][0]).tobytes())


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """row_id and the filter columns of a sidecar file."""
    data = Path(path).read_bytes()
    if data[:4] != b"FDAT":
        raise ValueError(f"{path}: no filter sidecar")
    n, m = struct.unpack_from("<QI", data, 4)
    kinds, at, names = data[16 : 16 + m], 16 + m, []
    for _ in range(m):
        (k,) = struct.unpack_from("<H", data, at)
        names.append(data[at + 2 : at + 2 + k].decode())
        at += 2 + k
    at += 1
    columns, types = [], []
    for kind in kinds:
        if kind in _KINDS:
            dtype = np.dtype(_KINDS[kind][0])
            v = np.frombuffer(data, dtype, n, at)
            at += n * dtype.itemsize
            columns.append(v.astype(bool).tolist() if kind == 3 else v.tolist())
            types.append(_KINDS[kind][1])
            continue
        values = []
        for _ in range(n):
            count, items = 1, []
            if kind == 5:
                count, at = data[at], at + 1
            for _ in range(count):
                (k,) = struct.unpack_from("<H", data, at)
                items.append(data[at + 2 : at + 2 + k].decode())
                at += 2 + k
            values.append(items if kind == 5 else items[0])
        columns.append(values)
        types.append("array<string>" if kind == 5 else "string")
    schema = ", ".join(["row_id long", *(f"`{a}` {t}" for a, t in zip(names, types))])
    return spark.createDataFrame(list(zip(range(n), *columns)), schema)


def write_results(results: DataFrame, path: str) -> None:
    """Tab-separated results in query and rank order within each file; payloads in hexadecimal."""
    out = results
    if "vector" in out.columns:
        out = out.withColumn("vector", F.array_join(F.col("vector").cast("array<string>"), ","))
    if "payload" in out.columns:
        out = out.withColumns({"payload_bytes": F.octet_length("payload"), "payload": F.hex("payload")})
    out.repartitionByRange("query_id").sortWithinPartitions("query_id", "rank").write.option("sep", "\t").csv(path)


class Metrics:
    """JSON lines of flat records with a phase and seconds."""

    PHASES = ("sample", "pca", "kmeans", "lloyd", "super", "stream", "write", "total")

    def __init__(self, path: str):
        self.path = path

    def record(self, phase: str, seconds: float, **values) -> None:
        if phase not in self.PHASES:
            raise ValueError(f"unknown phase {phase!r}")
        with open(self.path, "a") as f:
            f.write(json.dumps({"phase": phase, "seconds": seconds, **values}) + "\n")
