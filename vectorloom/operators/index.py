"""The index: built from a DataFrame, kept as Parquet tables of numbered versions, searched, changed and checked.

Each change writes new tables and then a manifest that names them; readers follow the newest manifest, so a failed
change leaves the index as it was.
"""

from __future__ import annotations

import json
import pickle
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.functions.predicates import Predicate, matches
from vectorloom.functions.vectors import IP, L2, distance, normalized
from vectorloom.operators import quantizers, routing, stats, summary, training
from vectorloom.operators.batches import runs, whole_groups
from vectorloom.operators.exact import SLACK, exact_knn, matrix, nearest
from vectorloom.operators.topk import adaptive_cut, auto_tau, deduplicated, ranked, shortlist_width
from vectorloom.sources.workspace import checkpointed, children, delete, shared_dir

RESERVED = {"row_id", "embedding", "payload", "leaf_id", "cluster_id", "code"}


@dataclass
class BuildOptions:
    metric: str = L2
    quantizer: str = "local_scalar"
    m: int | None = None
    bits: int | None = None
    leaf_capacity: int = 5000
    k_root: int = 0
    k_top: int = 0
    depth: int = 0
    pca_dims: int | None = None
    passes: int = 10
    closure: float = training.CLOSURE
    normalize: bool = False
    statistics: str = "off"
    plane: str | None = None
    plane_dims: int = 128


@dataclass
class SearchOptions:
    n_probe: int = 0
    fraction: float | None = None
    exhaustive: bool = False
    gap: float | None = None
    width: int | None = None
    rerank: str = "exact"  # exact, decoded, none
    tau: float | None = None  # None: no adaptive cut; 0: by code size
    use_plane: bool = True
    plane_keep: float | None = 0.25
    with_payload: bool = False
    with_vectors: bool = False
    per_query: dict = field(default_factory=dict)  # query_id -> predicates (None inherits, [] is unfiltered)


class Index:
    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path, manifest

    # --- storage ---------------------------------------------------------------------------------------------------

    @staticmethod
    def _latest(spark: SparkSession, path: str) -> int:
        return max((int(n[2:]) for n in children(spark, f"{path}/manifests") if n.startswith("v=")), default=0)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        version = cls._latest(spark, path)
        if not version:
            raise FileNotFoundError(f"no index at {path}")
        text = spark.read.text(f"{path}/manifests/v={version}", wholetext=True).first()[0]
        return cls(spark, path, json.loads(text))

    def _commit(self, tables: dict[str, str], **changes) -> Index:
        version = self._latest(self.spark, self.path) + 1
        manifest = {**self.manifest, **changes, "version": version, "tables": {**self.manifest.get("tables", {}), **tables}}
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{self.path}/manifests/v={version}")
        self.manifest = manifest
        return self

    def _write(self, name: str, df: DataFrame) -> str:
        path = f"{self.path}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.manifest["tables"][name])

    @property
    def schema(self) -> T.StructType:
        """The filter columns."""
        return T.StructType([f for f in self.table("vectors").schema if f.name not in RESERVED])

    def _state(self) -> dict:
        return pickle.loads(self.table("model").first()[0])

    # --- building --------------------------------------------------------------------------------------------------

    @classmethod
    def build(cls, df: DataFrame, path: str, options: BuildOptions | None = None, payload: str | None = None) -> Index:
        """df: row_id, embedding, filter columns; ``payload`` names a column that is stored but not filtered on."""
        o = options or BuildOptions()
        quantizers.make(o.quantizer, o.m, o.bits)
        if o.metric not in (L2, IP):
            raise ValueError(f"unknown metric {o.metric!r}")
        spark = df.sparkSession
        if payload:
            df = df.withColumn("payload", F.coalesce(F.col(payload).cast("binary"), F.lit(b""))).drop(*([payload] if payload != "payload" else []))
        base = df.withColumns({"row_id": F.col("row_id").cast("long"), "embedding": F.col("embedding").cast("array<float>")})
        if o.normalize:
            base = base.withColumn("embedding", normalized(F.col("embedding")))
        index = cls(spark, path, {})
        stored = index._write("vectors", base)
        base = spark.read.parquet(stored)
        low, high, nulls, rows = base.agg(F.min(F.size("embedding")), F.max(F.size("embedding")), F.sum(F.col("embedding").isNull().cast("int")), F.count("*")).first()
        if not rows or nulls or low != high or low < 1:
            raise ValueError("an index needs rows whose vectors all have one length")
        p = training.Parameters(o.leaf_capacity, o.k_root, o.k_top, o.depth, o.pca_dims).resolved(rows, low)
        x = training.sample(base)
        projection = training.learn_projection(x, p.pca_dims)
        small = projection(x)
        centres = training.first_centres(small, p.k_root if p.depth > 1 else 1)
        centres = training.refined(base, projection, centres, o.passes, small[:4096])
        radii = training.closure_radii(small, centres, o.closure)
        quantizer = quantizers.make(o.quantizer, o.m, o.bits).fit(x)
        top = quantizers.kmeans(centres, p.k_top, 20) if p.depth == 3 else None
        model = {"projection": projection, "centres": centres, "radii": radii, "quantizer": quantizer, "top": top}
        index.manifest = {"uuid": uuid.uuid4().hex, "dim": low, "metric": o.metric, "options": asdict(o), "depth": p.depth, "k_root": len(centres), "fraction": routing.default_fraction(rows)}
        homes = training.assigned(base.drop("payload"), projection, centres, radii)
        members, leaves = index._leaves(index._chunked(homes, p.leaf_capacity, {}), model)
        tables = {"vectors": stored, "members": members, "leaves": leaves, "model": index._write("model", spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary"))}
        stats_path = index._write("statistics", spark.createDataFrame([(bytearray(pickle.dumps(stats.collect(base.select(*[c for c in base.columns if c not in RESERVED]), o.statistics))),)], "stats binary"))
        index._commit({**tables, "statistics": stats_path}, rows=rows)
        if o.plane:
            index.attach_plane(o.plane, o.plane_dims)
        return index

    @staticmethod
    def _chunked(homes: DataFrame, capacity: int, taken: dict) -> DataFrame:
        """Rows of a cluster, in row order, cut into leaves of equal capacity; leaf ids begin after those taken."""
        numbered = homes.withColumn("at", F.row_number().over(Window.partitionBy("cluster_id").orderBy("row_id")) - 1).withColumn("chunk", F.floor(F.col("at") / capacity).cast("int"))
        return numbered.withColumn("leaf_id", F.col("cluster_id").cast("long") * (1 << 24) + F.col("chunk") + int(taken.get("first", 0))).drop("at", "chunk")

    def _leaves(self, rows: DataFrame, model: dict) -> tuple[str, str]:
        """Encodes whole leaves and writes members and leaves (with centroid, state and summary)."""
        q, metric, dim = model["quantizer"], self.manifest["metric"], self.manifest["dim"]
        shared = self.spark.sparkContext.broadcast(model)
        filters = [f for f in rows.schema if f.name not in RESERVED]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, project = shared.value["quantizer"], shared.value["projection"]
            for chunk in whole_groups(batches):
                leaf = chunk.column("leaf_id").to_numpy()
                x = matrix(chunk.column("embedding").combine_chunks(), dim)
                codes, centres, states = [], [None] * len(leaf), [None] * len(leaf)
                for a, b in runs(leaf):
                    part = x[a:b]
                    code, state = q.encode_leaf(part) if q.local else (q.encode(part), b"")
                    codes += [c.tobytes() for c in np.ascontiguousarray(code)]
                    centre = part.mean(0)
                    if metric == IP and np.linalg.norm(centre) > 0:
                        centre = centre / np.linalg.norm(centre)
                    centres[a], states[a] = [*centre.tolist(), *project(centre[None])[0].tolist()], state
                for batch in chunk.drop_columns(["embedding"]).append_column("code", pa.array(codes, pa.binary())).append_column("centre", pa.array(centres, pa.list_(pa.float64()))).append_column("state", pa.array(states, pa.binary())).combine_chunks().to_batches():
                    yield batch

        ordered = rows.select("leaf_id", "cluster_id", "row_id", "embedding", *[f.name for f in filters]).repartition("leaf_id").sortWithinPartitions("leaf_id", "row_id")
        schema = T.StructType([f for f in ordered.schema if f.name != "embedding"]).add("code", T.BinaryType()).add("centre", T.ArrayType(T.DoubleType())).add("state", T.BinaryType())
        encoded = checkpointed(ordered.mapInArrow(run, schema))
        members = self._write("members", encoded.drop("centre", "state", "cluster_id").repartition("leaf_id").sortWithinPartitions("leaf_id", "row_id"))
        heads = encoded.where("centre IS NOT NULL").select("leaf_id", "cluster_id", F.slice("centre", 1, dim).alias("centroid"), F.slice("centre", dim + 1, 1 << 20).alias("projected"), "state")
        zone = summary.leaf_summaries(encoded.drop("centre", "state", "code", "row_id", "cluster_id"), ["leaf_id"])
        return members, self._write("leaves", heads.join(zone, "leaf_id").withColumnRenamed("rows", "weight"))

    def attach_plane(self, kind: str = "sign", dims: int = 128) -> Index:
        """Adds a routing plane to an index without one: every row's coarse projection, beside its leaf."""
        if self.manifest["tables"].get("plane"):
            raise ValueError("the index has a plane already")
        plane = quantizers.Plane(kind, dims).fit(training.sample(self.table("vectors")))
        shared, dim = self.spark.sparkContext.broadcast(plane), self.manifest["dim"]

        @F.arrow_udf("binary")
        def encoded(v: pa.Array) -> pa.Array:
            return pa.array([r.tobytes() for r in shared.value.encode(matrix(v, dim)).astype("<f4")], pa.binary())

        rows = self.table("members").select("leaf_id", "row_id").join(self.table("vectors").select("row_id", "embedding"), "row_id")
        path = self._write("plane", rows.select("leaf_id", "row_id", encoded("embedding").alias("plane")))
        model = {**self._state(), "plane": plane}
        return self._commit({"plane": path, "model": self._write("model", self.spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary"))})

    # --- searching -------------------------------------------------------------------------------------------------

    def info(self) -> dict:
        m, leaves = self.manifest, self.table("leaves")
        live, n_leaves = leaves.agg(F.sum("weight"), F.count("*")).first()
        code = self.table("members").agg(F.max(F.octet_length("code"))).first()[0]
        return {"uuid": m["uuid"], "dim": m["dim"], "metric": m["metric"], "quantizer": m["options"]["quantizer"], "depth": m["depth"], "k_root": m["k_root"], "rows": m["rows"], "live": live or 0, "leaves": n_leaves, "code_bytes": code or 0, "columns": [(f.name, f.dataType.simpleString()) for f in self.schema], "plane": bool(m["tables"].get("plane"))}

    def statistics(self) -> stats.TableStats:
        return pickle.loads(self.table("statistics").first()[0])

    def selectivity(self, predicates: list[Predicate]) -> float | None:
        if not predicates:
            return None
        for p in predicates:
            p.checked(self.schema)
        return stats.combined(predicates, self.statistics())

    def search(self, queries: DataFrame, k: int, predicates: Iterable[Predicate] = (), options: SearchOptions | None = None) -> DataFrame:
        """(query_id, rank, row_id, dist[, payload][, vector]) of approximately the k nearest rows of each query."""
        o, predicates = options or SearchOptions(), list(predicates)
        if k < 1 or o.rerank not in ("exact", "decoded", "none"):
            raise ValueError("k must be positive, and rerank one of exact, decoded and none")
        if not o.per_query:
            return self._finished(self._one_filter(queries, k, predicates, o), o)
        # queries are grouped by their own predicates
        groups: dict[tuple, list] = {}
        for query_id, own in o.per_query.items():
            groups.setdefault(tuple(predicates if own is None else own), []).append(query_id)
        rest = queries.where(~F.col("query_id").isin([q for ids in groups.values() for q in ids]))
        out = self._one_filter(rest, k, predicates, o)
        for own, ids in groups.items():
            out = out.unionByName(self._one_filter(queries.where(F.col("query_id").isin(ids)), k, list(own), o))
        return self._finished(out, o)

    def _finished(self, found: DataFrame, o: SearchOptions) -> DataFrame:
        if o.with_payload or o.with_vectors:
            v = self.table("vectors")
            wanted = [F.col("embedding").alias("vector")] * o.with_vectors + [(F.col("payload") if "payload" in v.columns else F.lit(b"")).alias("payload")] * o.with_payload
            found = found.join(v.select("row_id", *wanted), "row_id", "left")
        return found.select("query_id", "rank", "row_id", "dist", *[c for c in ("payload", "vector") if c in found.columns])

    def _one_filter(self, queries: DataFrame, k: int, predicates: list[Predicate], o: SearchOptions) -> DataFrame:
        share = self.selectivity(predicates)
        plan = "route" if o.exhaustive else routing.strategy(share)
        if plan == "scan":
            return exact_knn(queries, self.table("vectors"), k, self.manifest["metric"], predicates)
        leaves = summary.surviving(self.table("leaves"), predicates, self.schema)
        every = plan == "visit_matching" or o.exhaustive
        if every:
            probes = self._all(queries, leaves)
        else:
            probes = self.probes(queries, o, leaves)
        width = shortlist_width(k, o.width)
        if every and o.rerank == "exact" and o.tau is None:
            return self._every(queries, k, leaves, predicates, width)
        return self._shortlisted(queries, k, probes, leaves, predicates, width, o)

    def _shortlisted(self, queries: DataFrame, k: int, probes: DataFrame, leaves: DataFrame, predicates: list[Predicate], width: int, o: SearchOptions) -> DataFrame:
        """The search proper: a shortlist by codes, then its order by what is asked for."""
        scanned = self.scan(queries, probes, leaves, predicates, width)
        if o.rerank == "exact":
            vectors = self.table("vectors").select("row_id", "embedding")
            both = scanned.join(vectors, "row_id").join(F.broadcast(queries.select("query_id", F.col("embedding").alias("query"))), "query_id")
            rows = both.select("query_id", "row_id", distance(F.col("query"), F.col("embedding"), self.manifest["metric"]).alias("dist"))
        else:
            rows = scanned.select("query_id", "row_id", F.col("scan_key").alias("dist"))
        rows = deduplicated(rows)
        if o.tau is not None and o.rerank != "none":
            code = self.table("members").select(F.octet_length("code")).first()
            return adaptive_cut(rows, k, o.tau or auto_tau(code[0] if code else 0))
        return ranked(rows, k)

    def _every(self, queries: DataFrame, k: int, leaves: DataFrame, predicates: list[Predicate], width: int) -> DataFrame:
        """A search in which every query visits the same leaves and reranks by vectors.

        The shortlist itself is not formed: where it would hold all that is visited, the answer is the order of the
        visited rows; where it is shorter, that holds for each query whose k best rows are no further down by their
        codes than its width, which is counted. Only the other queries take their shortlists."""
        metric = self.manifest["metric"]
        members = matches(self.table("members"), predicates).join(leaves.select("leaf_id"), "leaf_id", "left_semi")
        rows = self.table("vectors").select("row_id", "embedding").join(members.select("row_id"), "row_id", "left_semi")
        best = ranked(nearest(queries, rows, k, metric), k).select("query_id", "row_id", "dist", "rank")
        if (leaves.agg(F.sum("weight")).first()[0] or 0) <= width or members.count() <= width:
            return best
        best = checkpointed(best)
        last = self.estimates(best, queries).groupBy("query_id", "row_id").agg(F.min("estimate").alias("least")).groupBy("query_id").agg(F.max("least").alias("last"))
        ahead = self._ahead(queries.join(last, "query_id"), members, leaves)
        short = checkpointed(ahead.where(F.col("ahead") > width).select("query_id"))
        if short.isEmpty():
            return best
        rest = queries.join(F.broadcast(short), "query_id", "left_semi")
        found = self._shortlisted(rest, k, self._all(rest, leaves), leaves, predicates, width, SearchOptions())
        return best.join(F.broadcast(short), "query_id", "left_anti").unionByName(found.select(*best.columns))

    def _coded(self, rows: DataFrame, leaves: DataFrame) -> DataFrame:
        """Member rows with the state of their leaf, leaves in order."""
        if self._state()["quantizer"].local:
            rows = rows.join(leaves.select("leaf_id", "state"), "leaf_id")
        else:
            rows = rows.withColumn("state", F.lit(b""))
        return rows.sortWithinPartitions("leaf_id", "row_id")

    def estimates(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """(query_id, row_id, leaf_id, estimate): the decoded distances of pairs, one a replica of the row."""
        metric, dim = self.manifest["metric"], self.manifest["dim"]
        shared = self.spark.sparkContext.broadcast(self._state()["quantizer"])
        asked = pairs.select("query_id", "row_id").join(queries.select("query_id", F.col("embedding").alias("query")), "query_id")
        rows = self._coded(self.table("members").select("leaf_id", "row_id", "code").join(asked, "row_id"), self.table("leaves"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in whole_groups(batches):
                codes, states = chunk.column("code").to_pylist(), chunk.column("state")
                x = matrix(chunk.column("query").combine_chunks(), dim)
                found = np.empty(len(x))
                for a, b in runs(chunk.column("leaf_id").to_numpy()):
                    v = _decoded(shared.value, codes[a:b], states[a].as_py())
                    s = -np.einsum("ij,ij->i", x[a:b], v)
                    found[a:b] = 2 * s + (v * v).sum(1) + (x[a:b] ** 2).sum(1) if metric == L2 else s
                yield from chunk.select(["query_id", "row_id", "leaf_id"]).append_column("estimate", pa.array(found)).combine_chunks().to_batches()

        return rows.select("leaf_id", "row_id", "code", "state", "query_id", "query").mapInArrow(run, "query_id long, row_id long, leaf_id long, estimate double")

    def _ahead(self, queries: DataFrame, members: DataFrame, leaves: DataFrame) -> DataFrame:
        """(query_id, ahead): how many members lie no farther by their codes than the query's ``last``, or hardly so."""
        metric = self.manifest["metric"]
        block = [(r.query_id, np.asarray(r.embedding, np.float64), r.last) for r in queries.select("query_id", "embedding", "last").toLocalIterator()]
        shared = self.spark.sparkContext.broadcast((self._state()["quantizer"], np.array([b[0] for b in block], np.int64), np.array([b[1] for b in block]), np.array([b[2] for b in block])))
        rows = self._coded(members.select("leaf_id", "row_id", "code"), leaves)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, ids, x, last = shared.value
            norms = (x * x).sum(1)
            n = np.zeros(len(ids), np.int64)
            for chunk in whole_groups(batches):
                codes, states = chunk.column("code").to_pylist(), chunk.column("state")
                v = np.concatenate([_decoded(q, codes[a:b], states[a].as_py()) for a, b in runs(chunk.column("leaf_id").to_numpy())])
                for a in range(0, len(ids), 512):
                    part, lengths = slice(a, a + 512), norms[a : a + 512, None]
                    for b in range(0, len(v), 4096):
                        w = v[b : b + 4096]
                        square = (w * w).sum(1)
                        s = -(x[part] @ w.T)
                        s = (2 * s + square + lengths if metric == L2 else s) - SLACK * (1 + square + lengths)
                        n[part] += (s <= last[part, None]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["query_id", "ahead"])

        return rows.select("leaf_id", "row_id", "code", "state").mapInArrow(run, "query_id long, ahead long").groupBy("query_id").agg(F.sum("ahead").alias("ahead"))

    @staticmethod
    def _all(queries: DataFrame, leaves: DataFrame) -> DataFrame:
        return leaves.select("leaf_id").join(F.broadcast(queries.select("query_id")), F.lit(True))

    def leaf_distances(self, queries: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
        """(query_id, leaf_id, cluster_id, dist, weight): distances to leaf centroids in the projected space."""
        leaves = self.table("leaves") if leaves is None else leaves
        return self._to_centres(queries, leaves.select("leaf_id", "cluster_id", "weight", "projected"))

    def _to_centres(self, queries: DataFrame, rows: DataFrame) -> DataFrame:
        project = self._state()["projection"]
        shared, dim = self.spark.sparkContext.broadcast(project), self.manifest["dim"]

        @F.arrow_udf("array<double>")
        def projected(v: pa.Array) -> pa.Array:
            return pa.array(shared.value(matrix(v, dim)).tolist(), pa.list_(pa.float64()))

        q = queries.select("query_id", projected(F.col("embedding").cast("array<float>")).alias("q"))
        pairs = rows.join(F.broadcast(q), F.lit(True))
        d = F.aggregate(F.zip_with("q", "projected", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
        return pairs.withColumn("dist", d).drop("q", "projected")

    def probes(self, queries: DataFrame, o: SearchOptions, leaves: DataFrame | None = None) -> DataFrame:
        """(query_id, leaf_id) that routing chooses; every leaf of a chosen cluster is visited."""
        every = self.table("leaves")
        leaves = every if leaves is None else leaves
        model = self._state()
        if o.use_plane and self.manifest["tables"].get("plane") and not o.n_probe:
            return self._plane_probes(queries, o, leaves, model["plane"])
        weights = every.groupBy("cluster_id").agg(F.sum("weight").alias("weight"))
        rows = [(i, c.tolist()) for i, c in enumerate(model["centres"])]
        centres = self.spark.createDataFrame(rows, "cluster_id int, projected array<double>").join(F.broadcast(weights), "cluster_id")
        scored = self._to_centres(queries, centres)
        kind, amount = routing.resolve(self.manifest["rows"], self.manifest["k_root"], o.n_probe, o.fraction, self.manifest["fraction"])
        if model["top"] is not None and kind == "count":
            parent = quantizers.nearest(model["centres"], model["top"])
            tops = self.spark.createDataFrame([(i, c.tolist(), int((parent == i).sum())) for i, c in enumerate(model["top"])], "cluster_id int, projected array<double>, weight int")
            links = self.spark.createDataFrame(list(enumerate(parent.tolist())), "cluster_id int, parent_id int")
            first = routing.by_count(self._to_centres(queries, tops), routing.default_count(len(model["top"])), o.gap)
            chosen = routing.descend(first, scored.join(F.broadcast(links), "cluster_id"), int(amount), o.gap)
        elif kind == "fraction":
            chosen = routing.by_fraction(scored, amount)
        else:
            chosen = routing.by_count(scored, int(amount), o.gap)
        return leaves.select("leaf_id", "cluster_id").join(chosen.select("query_id", "cluster_id"), "cluster_id").select("query_id", "leaf_id")

    def _plane_probes(self, queries: DataFrame, o: SearchOptions, leaves: DataFrame, plane) -> DataFrame:
        block = [(r.query_id, np.asarray(r.embedding, np.float64)) for r in queries.select("query_id", "embedding").toLocalIterator()]
        if not block:
            return queries.select("query_id", F.lit(0).cast("long").alias("leaf_id")).limit(0)
        shared = self.spark.sparkContext.broadcast((np.array([b[0] for b in block], np.int64), plane.project(np.stack([b[1] for b in block]))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best: dict[int, np.ndarray] = {}
            for batch in batches:
                leaf = batch.column(0).to_numpy()
                s = q @ np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f4").reshape(len(leaf), -1).T.astype(np.float64)
                for leaf_id in np.unique(leaf).tolist():
                    top = s[:, leaf == leaf_id].max(1)
                    best[leaf_id] = np.maximum(best.get(leaf_id, top), top)
            for leaf_id, top in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), leaf_id)), pa.array(top)], ["query_id", "leaf_id", "score"])

        scores = self.table("plane").join(leaves.select("leaf_id"), "leaf_id", "left_semi").select("leaf_id", "plane").mapInArrow(run, "query_id long, leaf_id long, score double")
        fraction = o.fraction or self.manifest["fraction"]
        return routing.by_plane(scores, self.table("leaves"), fraction, o.plane_keep, self.leaf_distances(queries, leaves) if o.plane_keep else None).select("query_id", "leaf_id")

    def visited(self, queries: DataFrame, options: SearchOptions | None = None) -> DataFrame:
        """The trace of a search: (query_id, leaf_id, weight) of the leaves it reads."""
        o = options or SearchOptions()
        leaves = self.table("leaves")
        chosen = self._all(queries, leaves) if o.exhaustive else self.probes(queries, o, leaves)
        return chosen.join(leaves.select("leaf_id", "weight"), "leaf_id").select("query_id", "leaf_id", "weight")

    def search_stats(self, queries: DataFrame, options: SearchOptions | None = None) -> DataFrame:
        """One row: queries, leaf visits, distinct leaves (each is read once), rows scored, and visits a leaf."""
        v = self.visited(queries, options)
        out = v.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("visits"), F.count_distinct("leaf_id").alias("leaves"), F.sum("weight").alias("rows"))
        return out.withColumn("fanout", F.col("visits") / F.col("leaves"))

    def leaf_rows(self) -> DataFrame:
        """(leaf_id, rows, row_ids) of every leaf, whose size its capacity bounds."""
        return self.table("members").groupBy("leaf_id").agg(F.count("*").alias("rows"), F.array_sort(F.collect_list("row_id")).alias("row_ids"))

    def scan(self, queries: DataFrame, probes: DataFrame, leaves: DataFrame, predicates: list[Predicate], width: int) -> DataFrame:
        """(query_id, leaf_id, row_id, scan_key): the best ``width`` decoded rows of each query's leaves.

        Members of probed leaves are read once for all queries, filters first; each task decodes a leaf once, scores
        the queries that probe it by one matrix product, and sends no more than ``width`` rows a query."""
        model = self._state()
        metric, dim = self.manifest["metric"], self.manifest["dim"]
        block = [(r.query_id, np.asarray(r.embedding, np.float64)) for r in queries.select("query_id", "embedding").toLocalIterator()]
        if not block:
            return self.spark.createDataFrame([], "query_id long, leaf_id long, row_id long, scan_key double")
        shared = self.spark.sparkContext.broadcast((model["quantizer"], np.array([b[0] for b in block], np.int64), np.stack([b[1] for b in block])))
        askers = probes.groupBy("leaf_id").agg(F.collect_set("query_id").alias("askers"))
        rows = matches(self.table("members"), predicates).select("leaf_id", "row_id", "code").join(askers, "leaf_id")
        rows = self._coded(rows, leaves).select("leaf_id", "row_id", "code", "state", "askers")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, ids, x = shared.value
            at = {int(i): n for n, i in enumerate(ids)}
            heaps: dict[int, list] = {}
            for chunk in whole_groups(batches):
                leaf, row = chunk.column("leaf_id").to_numpy(), chunk.column("row_id").to_numpy()
                codes = chunk.column("code").to_pylist()
                for a, b in runs(leaf):
                    asked = np.array([at[i] for i in chunk.column("askers")[a].as_py()])
                    v = _decoded(q, codes[a:b], chunk.column("state")[a].as_py())
                    s = -(x[asked] @ v.T)
                    if metric == L2:
                        s = 2 * s + (v * v).sum(1) + (x[asked] ** 2).sum(1)[:, None]
                    for n, i in enumerate(asked.tolist()):
                        keep = np.argsort(s[n], kind="stable")[:width]
                        heaps.setdefault(i, []).append((s[n][keep], np.full(len(keep), leaf[a]), row[a:b][keep]))
                        if len(heaps[i]) > 64:
                            heaps[i] = [_best(heaps[i], width)]
            for i, parts in heaps.items():
                key, leaves_, rows_ = _best(parts, width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), ids[i])), pa.array(leaves_), pa.array(rows_), pa.array(key)], ["query_id", "leaf_id", "row_id", "scan_key"])

        scored = rows.mapInArrow(run, "query_id long, leaf_id long, row_id long, scan_key double")
        order = Window.partitionBy("query_id").orderBy("scan_key", "leaf_id", "row_id")
        return scored.withColumn("at", F.row_number().over(order)).where(F.col("at") <= width).drop("at")

    def feedback_blocks(self, queries: DataFrame, k: int) -> DataFrame:
        """The trace that stopping rules work on: a query's clusters from the nearest on, with how many of their rows
        entered the top k so far and the k-th distance after them."""
        model = self._state()
        weights = self.table("leaves").groupBy("cluster_id").agg(F.sum("weight").alias("weight"))
        centres = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model["centres"])], "cluster_id int, projected array<double>").join(F.broadcast(weights), "cluster_id")
        order = self._to_centres(queries, centres).withColumn("block", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "cluster_id"))).drop("dist")
        vectors = self.table("vectors").select("row_id", "embedding")
        home = self.table("members").select("leaf_id", "row_id").join(self.table("leaves").select("leaf_id", "cluster_id"), "leaf_id").select("cluster_id", "row_id").distinct().join(vectors, "row_id")
        measured = nearest(queries, home, k, self.manifest["metric"], group="cluster_id")
        # only a block's k best can enter
        best = measured.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "cluster_id").orderBy("dist", F.desc("row_id")))).where(F.col("n") <= k).drop("n")

        def walk(table: pa.Table) -> pa.Table:
            d = table.to_pydict()
            top: dict[int, float] = {}
            out = {"query_id": [], "block": [], "weight": [], "entered": [], "kth": []}
            seen: dict[int, list] = {}
            weight = {}
            for b, w, r, x in zip(d["block"], d["weight"], d["row_id"], d["dist"]):
                weight[b] = w
                if r is not None:
                    seen.setdefault(b, []).append((x, -r))
            for b in sorted(weight):
                before = set(top)
                for x, r in seen.get(b, []):
                    top[-r] = min(x, top.get(-r, x))
                top = dict(sorted(top.items(), key=lambda t: (t[1], -t[0]))[:k])
                for name, v in zip(out, (d["query_id"][0], b, weight[b], len(set(top) - before), max(top.values()) if len(top) == k else None)):
                    out[name].append(v)
            return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "block": pa.array(out["block"], pa.int32()), "weight": pa.array(out["weight"], pa.int64()), "entered": pa.array(out["entered"], pa.int64()), "kth": pa.array(out["kth"], pa.float64())})

        return order.join(best, ["query_id", "cluster_id"], "left").groupBy("query_id").applyInArrow(walk, "query_id long, block int, weight long, entered long, kth double")

    # --- changing --------------------------------------------------------------------------------------------------

    def insert(self, df: DataFrame) -> Index:
        """Adds rows, each to one leaf of its nearest cluster; leaves beyond twice their capacity are split."""
        if self.manifest["tables"].get("plane"):
            raise ValueError("an index with a plane takes no inserts")
        model, old = self._state(), self.table("vectors")
        missing = [c for c in old.columns if c not in df.columns]
        rows = df.select(*[c for c in old.columns if c not in missing]).withColumns({c: F.lit(None).cast(old.schema[c].dataType) for c in missing}).select(*[F.col(c).cast(old.schema[c].dataType) for c in old.columns])
        rows = self.spark.read.parquet(self._write("incoming", rows))
        if rows.where(F.col("embedding").isNull() | (F.size("embedding") != self.manifest["dim"])).count() or rows.join(old, "row_id", "left_semi").count() or rows.count() != rows.select("row_id").distinct().count():
            raise ValueError("new rows need vectors of the index's length and ids that aren't in use")
        homes = training.assigned(rows.drop("payload"), model["projection"], model["centres"], np.full(len(model["centres"]), -1.0))
        last = self.table("leaves").groupBy("cluster_id").agg(F.max(F.struct("leaf_id", "weight")).alias("last"))
        routed = homes.join(F.broadcast(last), "cluster_id", "left").withColumn("leaf_id", F.coalesce("last.leaf_id", F.col("cluster_id").cast("long") * (1 << 24))).drop("last")
        touched = checkpointed(routed.select("leaf_id").distinct())
        capacity = self.manifest["options"]["leaf_capacity"]
        kept = self.table("members").join(F.broadcast(touched), "leaf_id", "left_semi").select("leaf_id", "row_id").join(old.drop("payload"), "row_id").join(self.table("leaves").select("leaf_id", "cluster_id"), "leaf_id")
        whole = kept.unionByName(routed.select(*kept.columns))
        return self._replaced(touched, self._split(checkpointed(whole), capacity), {"vectors": self._write("vectors", old.unionByName(rows))}, self.manifest["rows"] + rows.count())

    def _split(self, rows: DataFrame, capacity: int) -> DataFrame:
        """Halves leaves by two-means until none holds more than twice its capacity."""
        dim = self.manifest["dim"]
        for _ in range(40):
            big = rows.groupBy("leaf_id").agg(F.count("*").alias("n")).where(F.col("n") > 2 * capacity).select("leaf_id")
            ids = [r.leaf_id for r in big.limit(1).collect()]
            if not ids:
                return rows
            highest = {r.cluster_id: r.top for r in rows.groupBy("cluster_id").agg(F.max("leaf_id").alias("top")).unionByName(self.table("leaves").groupBy("cluster_id").agg(F.max("leaf_id").alias("top"))).groupBy("cluster_id").agg(F.max("top").alias("top")).collect()}
            tops = self.spark.createDataFrame(list(highest.items()), "cluster_id int, top long")
            rank = F.dense_rank().over(Window.partitionBy("cluster_id").orderBy("leaf_id"))
            fresh = big.join(rows.select("leaf_id", "cluster_id").distinct(), "leaf_id").withColumn("nth", rank).join(F.broadcast(tops), "cluster_id").select("leaf_id", (F.col("top") + F.col("nth")).alias("fresh"))

            def halve(table: pa.Table) -> pa.Table:
                table = table.sort_by("row_id")
                x = matrix(table.column("embedding").combine_chunks(), dim)
                first, far = x[0], x[((x - x[0]) ** 2).sum(1).argmax()]
                side = quantizers.nearest(x, quantizers.kmeans(x, 2, 10, start=np.stack([first, far])))
                if not 0 < side.sum() < len(side):
                    side = np.arange(len(x)) % 2
                leaf = np.where(side == 1, table.column("fresh").to_numpy(), table.column("leaf_id").to_numpy())
                return table.set_column(table.schema.get_field_index("leaf_id"), "leaf_id", pa.array(leaf)).drop_columns(["fresh"])

            halves = rows.join(fresh, "leaf_id").groupBy("leaf_id").applyInArrow(halve, rows.select("leaf_id", *[c for c in rows.columns if c != "leaf_id"]).schema)
            rows = checkpointed(rows.join(big, "leaf_id", "left_anti").unionByName(halves))
        raise RuntimeError("leaves did not split")

    def _replaced(self, touched: DataFrame, rows: DataFrame, tables: dict, n: int) -> Index:
        """Writes the touched leaves anew beside the others."""
        members, leaves = self._leaves(rows, self._state())
        new_members, new_leaves = self.spark.read.parquet(members), self.spark.read.parquet(leaves)
        old_members = self.table("members").join(F.broadcast(touched), "leaf_id", "left_anti")
        old_leaves = self.table("leaves").join(F.broadcast(touched), "leaf_id", "left_anti")
        return self._commit({**tables, "members": self._write("members", old_members.unionByName(new_members)), "leaves": self._write("leaves", old_leaves.unionByName(new_leaves))}, rows=n)

    def delete(self, ids: DataFrame) -> tuple[Index, int]:
        """Removes rows with all their replicas; returns how many distinct ids there were of those asked for.

        Summaries stay as they are, still true but loose, until ``vacuum``."""
        asked = ids.select(F.col(ids.columns[0]).cast("long").alias("row_id")).distinct()
        old = self.table("vectors")
        n = old.join(asked, "row_id", "left_semi").count()
        members = self._write("members", self.table("members").join(asked, "row_id", "left_anti"))
        count = self.spark.read.parquet(members).groupBy("leaf_id").agg(F.count("*").alias("left"))
        leaves = self.table("leaves").join(count, "leaf_id", "left").withColumn("weight", F.coalesce("left", F.lit(0)).cast("long")).drop("left")
        tables = {"members": members, "leaves": self._write("leaves", leaves), "vectors": self._write("vectors", old.join(asked, "row_id", "left_anti"))}
        if self.manifest["tables"].get("plane"):
            tables["plane"] = self._write("plane", self.table("plane").join(asked, "row_id", "left_anti"))
        return self._commit(tables, rows=self.manifest["rows"] - n, dirty=True), n

    def vacuum(self, statistics: bool = False) -> Index:
        """Summaries out of the rows that are left, without empty leaves; with statistics, those too, modes kept."""
        zone = summary.leaf_summaries(self.table("members").drop("code", "row_id"), ["leaf_id"]).withColumnRenamed("rows", "weight")
        leaves = self.table("leaves").select("leaf_id", "cluster_id", "centroid", "projected", "state").join(zone, "leaf_id")
        tables = {"leaves": self._write("leaves", leaves)}
        if statistics:
            v = self.table("vectors")
            found = stats.collect(v.select(*[c for c in v.columns if c not in RESERVED]), self.manifest["options"]["statistics"])
            tables["statistics"] = self._write("statistics", self.spark.createDataFrame([(bytearray(pickle.dumps(found)),)], "stats binary"))
        return self._commit(tables, dirty=False)

    def compact(self) -> Index:
        """Rewrites the tables into few files and deletes what older versions left behind."""
        tables = {n: self._write(n, self.table(n).repartition("leaf_id").sortWithinPartitions("leaf_id", "row_id") if n == "members" else self.table(n)) for n in ("members", "leaves", "vectors")}
        self._commit(tables)
        used = {p.rsplit("/", 1)[-1] for p in self.manifest["tables"].values()}
        for name in ("members", "leaves", "vectors", "model", "statistics", "plane", "incoming"):
            for child in children(self.spark, f"{self.path}/{name}"):
                if child not in used:
                    delete(self.spark, f"{self.path}/{name}/{child}")
        return self

    def check(self) -> DataFrame:
        """(test, problems): what breaks the index's invariants; all zero when it is sound."""
        m, leaves, v = self.table("members"), self.table("leaves"), self.table("vectors")
        counted = m.groupBy("leaf_id").agg(F.count("*").alias("n"))
        tests = {
            "members_without_leaf": m.join(leaves, "leaf_id", "left_anti"),
            "leaf_counts": leaves.join(counted, "leaf_id", "left").where(F.coalesce("n", F.lit(0)) != F.col("weight")),
            "rows_without_member": v.join(m, "row_id", "left_anti"),
            "members_without_row": m.join(v, "row_id", "left_anti"),
            "repeated_in_leaf": m.groupBy("leaf_id", "row_id").agg(F.count("*").alias("n")).where("n > 1"),
            "repeated_rows": v.groupBy("row_id").agg(F.count("*").alias("n")).where("n > 1"),
            "repeated_leaves": leaves.groupBy("leaf_id").agg(F.count("*").alias("n")).where("n > 1"),
        }
        out = None
        for name, bad in tests.items():
            row = bad.agg(F.count("*").alias("problems")).select(F.lit(name).alias("test"), "problems")
            out = row if out is None else out.unionByName(row)
        return out

    def counts(self) -> DataFrame:
        """Physical slots (replicas counted) and logical rows."""
        return self.table("members").agg(F.count("*").alias("slots"), F.count_distinct("row_id").alias("rows"))


def _decoded(q, codes: list[bytes], state: bytes) -> np.ndarray:
    code = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return q.decode_leaf(code, state) if q.local else q.decode(code)


def _best(parts: list, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, leaf, row = (np.concatenate([p[i] for p in parts]) for i in range(3))
    keep = np.lexsort((row, leaf, key))[:width]
    return key[keep], leaf[keep], row[keep]


class IndexBuilder:
    """Push ingest: chunks of rows are appended to a staging table; ``finish`` builds the index out of them.

    A failed push leaves the builder usable, a failed finish leaves no index."""

    def __init__(self, spark: SparkSession, path: str, options: BuildOptions | None = None, payload: str | None = None):
        self.spark, self.path, self.options, self.payload = spark, path, options, payload
        self.staging, self.rows, self.open = f"{shared_dir(spark)}/staging-{uuid.uuid4().hex}", 0, True

    def push(self, df: DataFrame) -> int:
        """Appends rows; without row_id they are numbered on in the order of their ``position`` column."""
        if not self.open:
            raise ValueError("the builder is closed")
        if "embedding" not in df.columns or not isinstance(df.schema["embedding"].dataType, T.ArrayType):
            raise ValueError("rows need an embedding array")
        if "row_id" not in df.columns:
            order = "position" if "position" in df.columns else None
            if order is None:
                raise ValueError("rows need row_id or position")
            # one chunk of a push at a time
            df = df.withColumn("row_id", F.row_number().over(Window.orderBy(order)).cast("long") - 1 + self.rows).drop(order)
        n = df.count()
        df.write.mode("append").parquet(self.staging)
        self.rows += n
        return n

    def finish(self) -> Index:
        if not self.open or not self.rows:
            raise ValueError("nothing to build from")
        try:
            return Index.build(self.spark.read.parquet(self.staging), self.path, self.options, self.payload)
        except Exception:
            delete(self.spark, self.path)
            raise
        finally:
            self.abort()

    def abort(self) -> None:
        self.open = False
        delete(self.spark, self.staging)
