"""Serving: a stream of queries answered in micro-batches, and a stream of rows that becomes an index."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.predicates import Predicate
from vectorloom.operators.index import Index, IndexBuilder, SearchOptions


class Server:
    """Answers batches of (query_id, embedding[, k]) with one search for the batch at the largest k asked for, each
    query cut to its own; exact repeats come from a bounded memory keyed on vector, k, filters and options."""

    def __init__(self, index: Index, k: int, predicates: tuple[Predicate, ...] = (), options: SearchOptions | None = None, remember: int = 1024):
        self.index, self.k, self.predicates, self.options = index, k, tuple(predicates), options or SearchOptions()
        self.remember, self.memory = remember, OrderedDict()
        self.stats = {"batches": 0, "queries": 0, "repeats": 0}

    def _key(self, row) -> tuple:
        return tuple(row.embedding), row.k, self.predicates, repr(self.options), self.index.manifest["version"]

    def answer(self, batch: DataFrame) -> DataFrame:
        """(query_id, rank, row_id, dist). A micro-batch is small: its size is the trigger's to bound."""
        spark = self.index.spark
        asked = batch.select("query_id", "embedding", (F.col("k") if "k" in batch.columns else F.lit(self.k)).cast("int").alias("k")).collect()
        self.stats["batches"] += 1
        self.stats["queries"] += len(asked)
        known, fresh = [], []
        for row in asked:
            key = self._key(row)
            if key in self.memory:
                self.memory.move_to_end(key)
                known += [(row.query_id, *hit) for hit in self.memory[key]]
                self.stats["repeats"] += 1
            else:
                fresh.append(row)
        if fresh:
            queries = spark.createDataFrame([(r.query_id, r.embedding) for r in fresh], "query_id long, embedding array<float>")
            found: dict[int, list] = {}
            for r in self.index.search(queries, max(r.k for r in fresh), self.predicates, self.options).orderBy("query_id", "rank").collect():
                found.setdefault(r.query_id, []).append((r.rank, r.row_id, r.dist))
            for row in fresh:
                hits = [h for h in found.get(row.query_id, []) if h[0] <= row.k]
                self.memory[self._key(row)] = hits
                known += [(row.query_id, *h) for h in hits]
            while len(self.memory) > self.remember:
                self.memory.popitem(last=False)
        return spark.createDataFrame(known, "query_id long, rank int, row_id long, dist double")

    def stream(self, queries: DataFrame, sink: Callable[[DataFrame, int], None], trigger: dict | None = None, checkpoint: str | None = None):
        """Starts answering a streaming DataFrame; ``sink`` gets each batch's results and its number."""
        writer = queries.writeStream.foreachBatch(lambda batch, number: sink(self.answer(batch), number)).trigger(**(trigger or {"processingTime": "100 milliseconds"}))
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        return writer.start()


def ingest(rows: DataFrame, builder: IndexBuilder, checkpoint: str):
    """Starts pushing a streaming DataFrame of row_id, embedding and filter columns into a builder."""
    return rows.writeStream.foreachBatch(lambda batch, number: builder.push(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
