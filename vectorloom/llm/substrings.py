"""Exact removal of repeated byte strings across documents.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Every string of
that length has an anchor: among its ``GRAM``-byte grams those of the least hash. Anchors depend on the string alone, so
two occurrences of a string have the same anchors at the same offsets, and only strings about anchors that occur in
several documents need a closer look:

1. each task lists the anchors of its texts; those that it sees in two documents itself are known to be repeated (so a
   passage shared by very many documents costs one row a task), the others are brought together by hash, four bytes
   an anchor;
2. about each repeated anchor, the 2 * LENGTH - GRAM bytes of context go to the anchor's bucket, once a task if equal;
   there, of every string of LENGTH bytes through the anchor, the least document id is found; a string whose least id is
   smaller than its own document's is marked. A bucket beyond ``CELL`` contexts (an anchor may end a passage that very
   many documents go on from differently) is not gathered: its strings' hashes are brought together instead, each task
   sending but the first of equal ones;
3. marks return to their texts, which are cut.

Texts are shuffled once: steps 2 and 3 read the same exchange. Equal texts are grouped first, and only the one with the
smallest id is searched; the others are removed whole, if they have LENGTH bytes.

Defined results: a null text counts as empty; texts shorter than LENGTH keep everything; rows with null ids are neither
cut nor searched; several rows with one id are no earlier documents to each other; cutting may split a character, so
kept bytes are binary; other columns are not looked at, or carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import checkpointed, forget, maybe_broadcast, small_batches, whole_groups
from vectorloom.llm.simhash import _INVERSE, _ODD, mixed

LENGTH, GRAM = 50, 20
#: Anchors that a task gathers before it sends them on.
FLUSH = 500_000
#: Buckets of contexts for each partition, and contexts of one bucket that a task holds at once.
FINE, CELL = 8, 200_000
_WINDOWS = LENGTH - GRAM + 1
_SIDE = LENGTH - GRAM
_CONTEXT = 2 * LENGTH - GRAM
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        for i, base in enumerate((_ODD, _INVERSE)):
            _POWERS[i] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base)]))
    return _POWERS[0], _POWERS[1]


def _doubled(h: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Sliding minimum or maximum by doubling."""
    f, w = (np.minimum if least else np.maximum), 1
    while 2 * w <= width:
        h = f(h[:-w], h[w:])
        w *= 2
    return f(h[: -(width - w)], h[width - w :]) if width > w else h


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that have the least hash of some string of LENGTH bytes."""
    n = len(data)
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    power, inverse = _powers(n + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n])])
    h = mixed((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    least = _doubled(h, _WINDOWS, True)
    edge = np.zeros(_WINDOWS - 1, np.uint64)
    at = np.flatnonzero(_doubled(np.concatenate([edge, least, edge]), _WINDOWS, False) == h)
    return at, h[at]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of runs."""
    if not len(x):
        return x, np.empty(0, np.uint32)
    begin = np.append(0, np.flatnonzero(x[1:] != x[:-1]) + 1)
    return x[begin], np.diff(np.append(begin, len(x))).astype(np.uint32)


def _blobs(bucket: np.ndarray, kind: int, uid: np.ndarray, doc: np.ndarray, pos: np.ndarray, what: np.ndarray) -> Iterator[tuple]:
    """One row a bucket: columns of its entries as bytes, runs of documents shortened."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, uid, doc, pos, what = bucket[order], uid[order], doc[order], pos[order], what[order]
    begin = np.append(0, np.flatnonzero(np.diff(bucket)) + 1)
    for a, b in zip(begin.tolist(), np.append(begin[1:], len(bucket)).tolist()):
        values, lengths = _runs(uid[a:b])
        first = a + np.append(0, np.cumsum(lengths)[:-1]).astype(np.int64)
        yield int(bucket[a]), kind, values.tobytes(), doc[first].tobytes(), lengths.tobytes(), pos[a:b].astype(np.uint32).tobytes(), what[a:b].tobytes()


_BLOB = "bucket int, kind int, uid binary, doc binary, runs binary, pos binary, what binary"
_BLOB_TYPES = (pa.int32(), pa.int32(), *(pa.binary(),) * 5)
_BLOB_NAMES = ["bucket", "kind", "uid", "doc", "runs", "pos", "what"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BLOB_TYPES)], _BLOB_NAMES)


def _joined(chunk: pa.Table, kind: int, dtype) -> tuple[np.ndarray, ...]:
    """The entries of all blobs of a kind: uid, doc, pos, what."""
    picked = [i for i, k in enumerate(chunk.column("kind").to_pylist()) if k == kind]
    cat = lambda name, t: np.frombuffer(b"".join([chunk.column(name)[i].as_py() for i in picked]), t)
    runs = cat("runs", np.uint32)
    return np.repeat(cat("uid", np.int64), runs), np.repeat(cat("doc", np.int64), runs), cat("pos", np.uint32), cat("what", dtype)


def _sharded(uid: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(uid.view(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _bytes_of(column: pa.Array) -> Iterator[np.ndarray]:
    for v in column:
        b = v.as_buffer()
        yield np.frombuffer(b, np.uint8) if b is not None and b.size else np.empty(0, np.uint8)


def _list_anchors(texts: DataFrame, shards: int) -> DataFrame:
    """Kind 0: anchors to be brought together, by hash. Kind 1: anchors known to be repeated, by text."""

    def flush(parts: list) -> pa.RecordBatch:
        uid, doc, pos, h = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((doc, h))
        hs, ds = h[order], doc[order]
        new = np.append(True, hs[1:] != hs[:-1])
        group = np.cumsum(new) - 1
        several = np.maximum.reduceat(ds, np.flatnonzero(new)) > ds[new]
        known = np.zeros(len(h), bool)
        known[order] = several[group]
        sent = np.zeros(len(h), bool)
        sent[order] = new
        sent |= ~known
        bucket = (h % np.uint64(shards)).astype(np.int64)
        short = (h >> np.uint64(32)).astype(np.uint32)
        empty = np.empty(0, np.uint8)
        rows = list(_blobs(bucket[sent], 0, uid[sent], doc[sent], pos[sent], short[sent]))
        rows += [(*r[:6], empty.tobytes()) for r in _blobs(_sharded(uid[known], shards), 1, uid[known], doc[known], pos[known], np.zeros(int(known.sum()), np.uint8))]
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        parts, n = [], 0
        for batch in batches:
            for uid, doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes_of(batch.column(2))):
                at, h = anchors(data)
                if len(at):
                    parts.append((np.full(len(at), uid, np.int64), np.full(len(at), doc, np.int64), at, h))
                    n += len(at)
                if n >= FLUSH:
                    yield flush(parts)
                    parts, n = [], 0
        if parts:
            yield flush(parts)

    return texts.select("uid", "doc", "body").mapInArrow(run, _BLOB)


def _gathered(blobs: DataFrame, shards: int) -> DataFrame:
    return blobs.repartition(shards, "bucket").sortWithinPartitions("bucket")


def _repeated(blobs: DataFrame, shards: int) -> DataFrame:
    """Anchors that occur in several documents, by text (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches, rows=1):
            rows = [tuple(chunk.column(c)[i].as_py() for c in _BLOB_NAMES) for i, k in enumerate(chunk.column("kind").to_pylist()) if k == 1]
            uid, doc, pos, h = _joined(chunk, 0, np.uint32)
            if len(h):
                # buckets are told apart by the rest of the hash
                bucket = np.repeat(chunk.column("bucket").to_numpy(), [len(p.as_py()) // 4 if k == 0 else 0 for p, k in zip(chunk.column("pos"), chunk.column("kind").to_pylist())])
                full = h.astype(np.uint64) | (bucket.astype(np.uint64) << np.uint64(32))
                order = np.lexsort((doc, full))
                fs, ds = full[order], doc[order]
                new = np.append(True, fs[1:] != fs[:-1])
                several = np.maximum.reduceat(ds, np.flatnonzero(new)) > ds[new]
                at = np.sort(order[several[np.cumsum(new) - 1]])
                rows += [(*r[:6], b"") for r in _blobs(_sharded(uid[at], shards), 1, uid[at], doc[at], pos[at], np.zeros(len(at), np.uint8))]
            if rows:
                yield _batch(rows)

    return _gathered(blobs, shards).mapInArrow(run, _BLOB)


def _by_text(blobs: DataFrame, shards: int, dtype) -> DataFrame:
    """One row a text: its marked positions, and what is said of each."""
    size = np.dtype(dtype).itemsize if dtype else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches, rows=1):
            uid, _, pos, what = _joined(chunk, 1, dtype or np.uint8)
            order = np.lexsort((pos, uid))
            uid, pos = uid[order], pos[order]
            what = what[order] if size else what
            values, lengths = _runs(uid)
            end = np.cumsum(lengths, dtype=np.int64)
            begin = end - lengths
            p, w = pos.tobytes(), what.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(values), pa.array([p[4 * a : 4 * b] for a, b in zip(begin, end)], pa.binary()), pa.array([w[size * a : size * b] for a, b in zip(begin, end)], pa.binary())], ["uid", "pos", "what"]
            )

    return _gathered(blobs, shards).mapInArrow(run, "uid long, pos binary, what binary")


def _contexts(texts: DataFrame, shards: int) -> DataFrame:
    """Kind 0: contexts by anchor (first of their kind in this task). Kind 1: full marks, by text, for the others."""

    def flush(parts: list) -> pa.RecordBatch:
        uid, doc, pos = (np.concatenate([p[i] for p in parts]) for i in range(3))
        rows = np.concatenate([p[3] for p in parts])
        key = _context_hash(rows)
        order = np.lexsort((doc, key))
        ks, ds = key[order], doc[order]
        new = np.append(True, ks[1:] != ks[:-1])
        least = ds[new][np.cumsum(new) - 1]
        later = np.zeros(len(key), bool)
        later[order] = ds > least
        first = np.zeros(len(key), bool)
        first[order] = new
        # repeated anchors within one document are all sent
        sent = first | ~later
        mark = rows[:, :4].copy().view(np.uint32)[:, 0]
        gram = np.ascontiguousarray(rows[:, 4 + _SIDE : 4 + _SIDE + GRAM])
        gram = _row_hash(gram)
        bucket = (gram % np.uint64(FINE * shards)).astype(np.int64)
        at = np.flatnonzero(sent)
        at = at[np.argsort(gram[at], kind="stable")]  # alike contexts side by side are compressed best
        squeeze = zstandard.ZstdCompressor(level=3).compress
        out = [(*r[:6], squeeze(r[6])) for r in _blobs(bucket[at], 0, uid[at], doc[at], pos[at], rows[at])]
        out += list(_blobs(_sharded(uid[later & ~sent], shards), 1, uid[later & ~sent], doc[later & ~sent], pos[later & ~sent], mark[later & ~sent]))
        return _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for uid, doc, data, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes_of(batch.column(2)), batch.column(3).to_pylist()):
                pos = np.frombuffer(spots, np.uint32).astype(np.int64)
                for lo in range(0, len(pos), 50_000):
                    at = pos[lo : lo + 50_000]
                    parts.append((np.full(len(at), uid, np.int64), np.full(len(at), doc, np.int64), at, context_rows(data, at)))
                    n += len(at)
                    if n >= FLUSH // 4:
                        yield flush(parts)
                        parts, n = [], 0
        if parts:
            yield flush(parts)

    return texts.mapInArrow(run, _BLOB)


def context_rows(data: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Per anchor four bytes telling which strings through it exist (bit a: that begins a bytes before it), and its context."""
    padded = np.concatenate([np.zeros(_SIDE, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    context = padded[pos[:, None] + np.arange(_CONTEXT)]
    a = np.arange(_WINDOWS)
    exists = (pos[:, None] - a >= 0) & (pos[:, None] - a + LENGTH <= len(data))
    mark = (exists.astype(np.uint32) << a.astype(np.uint32)).sum(1, dtype=np.uint32)
    return np.hstack([mark[:, None].view(np.uint8).reshape(len(pos), 4), context])


def _row_hash(rows: np.ndarray) -> np.ndarray:
    power, _ = _powers(rows.shape[1] + 1)
    return mixed((rows.astype(np.uint64) + np.uint64(1)) @ power[1 : rows.shape[1] + 1])


def _context_hash(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.uint64)
    for a in range(0, len(rows), 20_000):
        out[a : a + 20_000] = _row_hash(rows[a : a + 20_000])
    return out


def string_marks(rows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per context, which of the strings through its anchor also start in a document with a smaller id."""
    # equal contexts: the later documents' strings are all marked
    key = _context_hash(rows)
    order = np.lexsort((doc, key))
    ks, ds = key[order], doc[order]
    new = np.append(True, ks[1:] != ks[:-1])
    group = np.cumsum(new) - 1
    exists = rows[:, :4].copy().view(np.uint32)[:, 0]
    mark = np.zeros(len(rows), np.uint32)
    late = order[ds > ds[new][group]]
    mark[late] = exists[late]
    rest = np.sort(order[ds == ds[new][group]])
    a = np.arange(_WINDOWS)
    # of the rest, every string as a hash; _SIDE - a is where it begins in the context
    power, inverse = _powers(_CONTEXT + 1)
    hashes = np.empty((_WINDOWS, len(rest)), np.uint64)
    begin = _SIDE - a
    for lo in range(0, len(rest), 10_000):
        part = rows[rest[lo : lo + 10_000], 4:]
        total = np.zeros((len(part), _CONTEXT + 1), np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:_CONTEXT], axis=1, out=total[:, 1:])
        hashes[:, lo : lo + 10_000] = mixed((total[:, begin + LENGTH] - total[:, begin]) * inverse[begin]).T
    # one offset at a time: equal strings have their anchors at equal offsets
    for k in range(_WINDOWS):
        i = np.flatnonzero(exists[rest] >> np.uint32(k) & np.uint32(1))
        if not len(i):
            continue
        order = i[np.argsort(hashes[k, i], kind="stable")]
        hs, d = hashes[k, order], doc[rest[order]]
        new = np.append(True, hs[1:] != hs[:-1])
        least = np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1]
        mark[rest[order[d > least]]] |= np.uint32(1 << k)
    return mark


def _entries(row: tuple) -> tuple[np.ndarray, ...]:
    """uid, doc, pos and context rows of one blob."""
    runs = np.frombuffer(row[4], np.uint32)
    uid, doc = (np.repeat(np.frombuffer(row[i], np.int64), runs) for i in (2, 3))
    return uid, doc, np.frombuffer(row[5], np.uint32), np.frombuffer(zstandard.ZstdDecompressor().decompress(row[6]), np.uint8).reshape(len(uid), 4 + _CONTEXT)


def _strings(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, offset before the anchor, and hash of every string through an anchor."""
    power, inverse = _powers(_CONTEXT + 1)
    begin = _SIDE - np.arange(_WINDOWS)
    total = np.zeros((len(rows), _CONTEXT + 1), np.uint64)
    np.cumsum((rows[:, 4:].astype(np.uint64) + np.uint64(1)) * power[:_CONTEXT], axis=1, out=total[:, 1:])
    h = mixed((total[:, begin + LENGTH] - total[:, begin]) * inverse[begin])
    exists = rows[:, :4].copy().view(np.uint32)[:, 0]
    i, a = np.nonzero(exists[:, None] >> np.arange(_WINDOWS, dtype=np.uint32) & np.uint32(1))
    return i, a, h[i, a]


_STRING = np.dtype([("a", "u1"), ("h", "<u8")])


def _later(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal hash with a smaller document id, and which are the first of theirs."""
    order = np.lexsort((doc, h))
    hs, ds = h[order], doc[order]
    new = np.append(True, hs[1:] != hs[:-1])
    late, first = np.zeros(len(h), bool), np.zeros(len(h), bool)
    late[order] = ds > ds[new][np.cumsum(new) - 1]
    first[order] = new
    return late, first


def _spread(uid: np.ndarray, doc: np.ndarray, pos: np.ndarray, rows: np.ndarray, shards: int) -> Iterator[tuple]:
    """A part of a large bucket, string by string: marks (kind 1) and the strings to be brought together (kind 2)."""
    i, a, h = _strings(rows)
    late, first = _later(h, doc[i])
    m = np.flatnonzero(late)
    yield from _blobs(_sharded(uid[i[m]], shards), 1, uid[i[m]], doc[i[m]], pos[i[m]], np.uint32(1) << a[m].astype(np.uint32))
    m = np.flatnonzero(first | ~late)
    what = np.empty(len(m), _STRING)
    what["a"], what["h"] = a[m], h[m]
    yield from _blobs((h[m] % np.uint64(shards)).astype(np.int64), 2, uid[i[m]], doc[i[m]], pos[i[m]], what)


def _marked(blobs: DataFrame, shards: int) -> DataFrame:
    """Marks by text (kind 1), and strings of large buckets (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, n, large = None, [], 0, False

        def done() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            uid, doc, pos, rows = (np.concatenate([p[i] for p in parts]) for i in range(4))
            if large:
                for lo in range(0, len(uid), 20_000):
                    yield _batch(list(_spread(uid[lo : lo + 20_000], doc[lo : lo + 20_000], pos[lo : lo + 20_000], rows[lo : lo + 20_000], shards)))
                return
            mark = string_marks(rows, doc)
            at = np.flatnonzero(mark)
            if len(at):
                yield _batch(list(_blobs(_sharded(uid[at], shards), 1, uid[at], doc[at], pos[at], mark[at])))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] == 1:
                    yield _batch([row])
                    continue
                if row[0] != bucket:
                    yield from done()
                    bucket, parts, n, large = row[0], [], 0, False
                parts.append(_entries(row))
                n += len(parts[-1][0])
                if n >= CELL:
                    large = True
                    yield from done()
                    parts, n = [], 0
        yield from done()

    return _gathered(blobs, shards).mapInArrow(run, _BLOB)


def _settled(blobs: DataFrame, shards: int) -> DataFrame:
    """Marks by text (kind 1): those found before, and those of strings brought together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches, rows=1):
            rows = [tuple(chunk.column(c)[i].as_py() for c in _BLOB_NAMES) for i, k in enumerate(chunk.column("kind").to_pylist()) if k == 1]
            uid, doc, pos, what = _joined(chunk, 2, _STRING)
            if len(uid):
                late, _ = _later(what["h"], doc)
                at = np.flatnonzero(late)
                rows += list(_blobs(_sharded(uid[at], shards), 1, uid[at], doc[at], pos[at], np.uint32(1) << what["a"][at].astype(np.uint32)))
            if rows:
                yield _batch(rows)

    return _gathered(blobs, shards).mapInArrow(run, _BLOB)


def removed_spans(pos: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs that the marked strings cover."""
    a = np.arange(_WINDOWS)
    start = np.unique((pos.astype(np.int64)[:, None] - a)[(mark[:, None] >> a.astype(np.uint32) & np.uint32(1)).astype(bool)])
    if not len(start):
        return start, start
    gap = np.flatnonzero(np.diff(start) > LENGTH)
    return start[np.append(0, gap + 1)], start[np.append(gap, len(start) - 1)] + LENGTH


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, spans (begin and end of each removed run), kept (bytes), text, carry.

    ``text`` is what stays as characters: those that a cut splits are left out."""
    spark = docs.sparkSession
    small_batches(spark)
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc"), body.cast("binary").alias("body"), (F.lit(0) if carry is None else carry).alias("carry"))
    base = base.withColumn("uid", F.xxhash64("doc", "body"))
    first = checkpointed(base.where("doc IS NOT NULL").groupBy(F.unhex(F.substring(F.sha2("body", 256), 1, 32)).alias("digest")).agg(F.min(F.struct("doc", "uid")).alias("who")).select("who.doc", "who.uid"))
    n = first.count()
    searched = base.where(F.octet_length("body") >= LENGTH).join(maybe_broadcast(first.select("uid").distinct(), n, 16), "uid", "left_semi")
    spread = base.repartition(shards, "uid")
    spots = _by_text(_repeated(_list_anchors(searched, shards), shards), shards, None)
    # carry is passed along unused, so that both readers of the exchange want the same columns
    about = spread.join(spots.select("uid", "pos").hint("shuffle_hash"), "uid").select("uid", "doc", "body", "pos", "carry")
    marks = _by_text(_settled(_marked(_contexts(about, shards), shards), shards), shards, np.uint32)
    known = first.select("uid").distinct().withColumn("first", F.lit(True)).join(marks.withColumnRenamed("what", "mark"), "uid", "left")
    found = spread.join(known.hint("shuffle_hash"), "uid", "left")

    @F.arrow_udf("n_removed long, n_spans long, spans array<long>, kept binary, text string")
    def removed(body: pa.Array, pos: pa.Array, mark: pa.Array, whole: pa.Array) -> pa.Array:
        forget()
        n_removed, n_spans, spans, kept, text = [], [], [], [], []
        for data, p, m, w in zip(_bytes_of(body), pos.to_pylist(), mark.to_pylist(), whole.to_pylist()):
            if w:
                begin, end = np.array([0]), np.array([len(data)])
            elif p:
                begin, end = removed_spans(np.frombuffer(p, np.uint32), np.frombuffer(m, np.uint32))
            else:
                begin = end = np.empty(0, np.int64)
            n_removed.append(int((end - begin).sum()))
            n_spans.append(len(begin))
            spans.append(np.stack([begin, end], 1).ravel().tolist())
            edges = [0, *spans[-1], len(data)]
            raw = data.tobytes()
            parts = [raw[a:b] for a, b in zip(edges[::2], edges[1::2])]
            kept.append(b"".join(parts))
            text.append("".join([p.decode("utf-8", "ignore") for p in parts]))
        return pa.StructArray.from_arrays([pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary()), pa.array(text, pa.string())], ["n_removed", "n_spans", "spans", "kept", "text"])

    # else a filter on a result would have every text cut twice, with twice the workers
    removed = removed.asNondeterministic()
    whole = F.col("first").isNull() & F.col("doc").isNotNull() & (F.octet_length("body") >= LENGTH)
    out = found.withColumn("out", removed("body", "pos", "mark", whole))
    return out.select(F.col("doc").alias("doc_id"), F.octet_length("body").cast("long").alias("n_bytes"), "out.*", "carry")


def cut_digest(docs: DataFrame) -> DataFrame:
    return cut(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
