"""Near-duplicate documents by SimHash and bit sampling.

A document is the set of its five-word shingles (words between ASCII white space; shorter texts form one shingle). Its
SimHash has ``BITS`` bits: signs of the sums, over its shingles, of that many pseudo-random signs. Each of several
tables samples ``bits`` of these coordinates; documents that agree on all of them share a bucket. How many coordinates a
table samples follows from the number of texts, and how many tables there are from the probability that two documents
of the threshold similarity agree on a coordinate, so that such a pair is missed by all tables or lost to the filters
in at most ``1 - RECALL`` of the cases.

Texts of few shingles don't follow the angle formula, so pairs of which one has at most ``SHORT`` are found exactly: two
sets of the threshold similarity share one of the smallest ``n - ceil(threshold n) + 1`` of their n hashes, and texts that
share one are compared by their whole sets.

Equal texts are grouped first, and one stands for all. Within a cell, pairs whose codes differ in no more coordinates
than a similar pair may are candidates. In a first pass each text is verified against the first such text of its cell
only, so that a group of near copies gives about as many pairs as it has texts; the texts of pairs so withheld go through
a second pass, in which only pairs that the verified links don't join already are written. A bucket beyond ``CELL`` rows
is capped by additional bits of the code, and what these leave too large is cut by hashed ids; the pairs so parted are
compared in cells of bounded size, the rows outside the bucket's largest class against all of it. Candidates are verified
by the Jaccard similarity of their shingle sets, and the verified edges are closed to classes.

Defined results: a null text counts as empty; empty texts (and texts of white space only) are copies of each other only
if equal byte for byte; rows with a null id are returned as singletons; repeated rows get the same class; the smallest
id of a class names it; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import blake2b
from math import ceil, lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import checkpointed, forget, map_arrow, maybe_broadcast, stored, whole_groups
from vectorloom.llm.graph import components

SHINGLE, THRESHOLD = 5, 0.8
BITS = 512
#: Of these, the first CHECK are carried to compare candidates.
CHECK = 128
RECALL = 0.998
#: Pairs whose smaller set has at most so many shingles are found by shared shingles.
SHORT = 40
MEAN_BUCKET, CELL = 256, 2048
#: Standard deviations that a similar pair's distance may lie above its mean, by the first CHECK bits and by all.
SLACK = 4.0
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base ** 2 and so on to n of them; as many as common texts need are kept."""
    if n <= len(table := _usual(base)):
        return table[:n]
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base)]))


@cache
def _usual(base: np.uint64) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << 16) - 1, base)]))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a text's bytes, by differences of a running polynomial."""
    solid = ~_SPACE[data]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.empty(0, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _powers(_ODD, len(data))
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=running[1:])
    inverse = _powers(_INVERSE, begin[-1] + 1)
    return mixed((running[end] - running[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words."""
    w = word_hashes(np.frombuffer((text or "").encode(), np.uint8))
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = mixed(h * _ODD + w[i : i + len(h)])
    return np.unique(h)


def simhash(h: np.ndarray) -> np.ndarray:
    """BITS signs of a set of hashes; ties and the empty set give zeros."""
    ones = np.zeros(BITS, np.int64)
    lanes = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * _ODD
    for at in range(0, len(h), 4080):
        part = mixed(h[at : at + 4080, None] ^ lanes[None, :])
        bits = np.unpackbits(part.view(np.uint8).ravel()).reshape(len(part), -1)
        for few in range(0, len(bits), 255):  # what a byte can count
            ones += bits[few : few + 255].sum(0, dtype=np.uint8)
    return 2 * ones > len(h)


def agreement(similarity: float) -> float:
    """The probability that sets of equal size and this Jaccard similarity agree on a coordinate."""
    return 1 - float(np.arccos(2 * similarity / (1 + similarity))) / np.pi


@cache
def _sums(n: int) -> np.ndarray:
    """The probabilities of the sums -n..n of n random signs."""
    p = np.ones(1)
    for _ in range(n):
        p = np.convolve(p, [0.5, 0.0, 0.5])
    return p


def disagreement(common: int, a: int, b: int) -> float:
    """The probability that sets with so many common and own elements differ in a coordinate; ties give zeros."""
    at = np.arange(-common, common + 1)

    def positive(k: int) -> np.ndarray:
        above = np.append(np.cumsum(_sums(k)[::-1])[::-1], 0.0)
        return above[np.clip(k + 1 - at, 0, 2 * k + 1)]

    p, q = positive(a), positive(b)
    return float((_sums(common) * (p * (1 - q) + q * (1 - p))).sum())


@cache
def miss(threshold: float) -> float:
    """The largest probability that a pair of the threshold similarity and more than SHORT shingles differs in a coordinate."""
    most = 1 - agreement(threshold)
    for m in range(SHORT + 1, 2 * SHORT + 1):
        for n in range(m, int(m / threshold + 1e-9) + 1):
            common = ceil(threshold * (m + n) / (1 + threshold) - 1e-9)
            if common <= m:
                most = max(most, disagreement(common, m - common, n - common))
    return most


def found(bits: int, tables: int, differ: float, threshold: float = THRESHOLD) -> float:
    """The probability that a pair that differs in a coordinate with this probability shares a bucket and passes the
    filter by whole codes. The tables sample the same coordinates, so it is a mean over the distance."""
    d = np.arange(min(BITS, farthest(BITS, threshold)) + 1)
    ways = np.array([lgamma(BITS + 1) - lgamma(k + 1) - lgamma(BITS - k + 1) for k in d])
    weight = np.exp(ways + d * np.log(differ) + (BITS - d) * np.log1p(-differ))
    agree = np.prod([np.maximum(BITS - d - i, 0) / (BITS - i) for i in range(bits)], axis=0)
    return float((weight * (1 - (1 - agree) ** tables)).sum())


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """How many coordinates a table samples, and how many tables there are."""
    bits = int(np.clip(np.ceil(np.log2(max(2, n) / MEAN_BUCKET)), 4, 40))
    tables = int(np.ceil(np.log(1 - recall) / np.log(1 - (1 - miss(threshold)) ** bits)))
    while found(bits, tables, miss(threshold), threshold) < recall:
        tables += max(1, tables // 100)
    return bits, tables


def farthest(bits: int, threshold: float) -> int:
    """In how many of so many coordinates a pair of the threshold similarity may differ."""
    differ = miss(threshold)
    return int(bits * differ + SLACK * np.sqrt(bits * differ * (1 - differ)))


def _samples(bits: int, tables: int) -> np.ndarray:
    rng = np.random.default_rng(11)
    return np.stack([rng.permutation(BITS)[:bits] for _ in range(tables)])


def codes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document with an id: doc_id, digest of the text, number of shingles, SimHash, and of few shingles their hashes."""
    few = int(SHORT / threshold + 1e-9)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        forget()
        digest, size, code, hashes = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text)
            digest.append(blake2b((text or "").encode(), digest_size=16).digest())
            size.append(len(s))
            code.append(np.packbits(simhash(s)).tobytes())
            hashes.append(_packed(s) if 0 < len(s) <= few else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(code, pa.binary()), pa.array(hashes, pa.binary())], ["doc_id", "digest", "size", "code", "hashes"])

    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    return map_arrow(source, "body", kernel, "doc_id long, digest binary, size int, code binary, hashes binary")


def _emit(distinct: DataFrame, bits: int, tables: int) -> DataFrame:
    """One row a text and table: bucket, id, number of shingles, the first CHECK bits of the code, and the class if given."""
    chosen = _samples(bits, tables)
    power = 1 << np.arange(bits, dtype=np.int64)
    carried = [c for c in ("class",) if c in distinct.columns]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        signs = np.unpackbits(packed, axis=1)
        keys = signs[:, chosen] @ power + (np.arange(tables, dtype=np.int64) << 44)
        rows = pa.array(np.repeat(np.arange(batch.num_rows), tables))
        short = pa.array([r.tobytes() for r in packed[:, : CHECK // 8]], pa.binary())
        others = [batch.column(i).take(rows) for i in range(3, batch.num_columns)]
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(rows), batch.column(1).take(rows), short.take(rows), *others], ["key", "id", "size", "code", *carried])

    source = distinct.where(F.col("size") > SHORT).select("id", "size", "code", *carried)
    return map_arrow(source, "code", kernel, "key long, id long, size int, code binary" + "".join(f", {c} long" for c in carried))


@dataclass
class _Split:
    """Buckets beyond CELL rows (key, n), how many they are, and their parts by additional bits that are still beyond it
    (key, part, cuts)."""

    hot: DataFrame
    many: int
    large: DataFrame | None = None
    many_large: int = 0


def _part(rows: DataFrame, split: _Split) -> DataFrame:
    """Adds ``part``: null, or for rows of oversized buckets as many further bits of the code as bring it down to CELL."""
    joined = rows.join(maybe_broadcast(split.hot, split.many, 16), "key", "left")
    mask = F.expr(f"shiftleft(1, least(16, cast(ceil(log2(2 * n / {CELL})) as int))) - 1")
    more = F.conv(F.hex(F.substring("code", 1, 2)), 16, 10).cast("int").bitwiseAND(mask)
    return joined.withColumn("part", F.when(F.col("n").isNotNull(), F.coalesce(more, F.lit(0)))).drop("n")


def _split(rows: DataFrame) -> _Split:
    hot = checkpointed(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CELL))
    split = _Split(hot, hot.count())
    if split.many:
        sizes = _part(rows, split).where("part IS NOT NULL").groupBy("key", "part").agg(F.count("*").alias("m")).where(F.col("m") > CELL)
        split.large = checkpointed(sizes.select("key", "part", F.ceil(2 * F.col("m") / CELL).cast("int").alias("cuts")))
        split.many_large = split.large.count()
    return split


def _celled(rows: DataFrame, split: _Split) -> DataFrame:
    """Each row in one cell: its bucket, or a part of it by additional bits of its code, then by its id."""
    if "class" not in rows.columns:
        rows = rows.withColumn("class", F.lit(None).cast("long"))
    if split.many == 0:
        return rows.withColumns({"cell": F.col("key"), "side": F.lit(0)})
    parted = _part(rows, split).join(maybe_broadcast(split.large, split.many_large, 24), ["key", "part"], "left")
    cut = F.coalesce(F.pmod(F.xxhash64("id", "key"), F.col("cuts")), F.lit(0))
    cell = F.when(F.col("part").isNull(), F.col("key")).otherwise(F.xxhash64("key", "part", cut))
    return parted.withColumns({"cell": cell, "side": F.lit(0)}).drop("part", "cuts")


def _parted(rows: DataFrame, split: _Split, grouped: DataFrame) -> DataFrame:
    """Cells of what ``_celled`` parted: by bucket, the rows outside its largest class (side 1) against all rows (side 2)."""
    within = rows.join(maybe_broadcast(split.hot, split.many, 16), "key").drop("n")
    within = within.join(grouped.select(F.col("node").alias("id"), F.col("component").alias("class")), "id", "left")
    within = checkpointed(within.withColumn("class", F.coalesce("class", "id")))
    main = within.groupBy("key", "class").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "class")).alias("main"), F.sum("n").alias("all"))
    half = CELL // 2
    sizes = main.select("key", F.col("main.class").alias("main"), F.ceil((F.col("all") - F.col("main.n")) / half).cast("int").alias("a"), F.ceil(F.col("all") / half).cast("int").alias("b")).where("a > 0")
    within = within.join(maybe_broadcast(sizes, split.many, 24), "key")

    def at(parts: str, salt: str):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.col(parts)).cast("int")

    def every(parts: str):
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    rest = within.where(F.col("class") != F.col("main")).withColumn("i", at("a", "rest")).withColumn("j", every("b")).withColumn("side", F.lit(1))
    whole = within.withColumn("j", at("b", "all")).withColumn("i", every("a")).withColumn("side", F.lit(2))
    return rest.unionByName(whole).withColumn("cell", F.xxhash64("key", "i", "j")).drop("main", "a", "b", "i", "j")


def _candidates(cells: DataFrame, threshold: float, first: bool) -> DataFrame:
    """Distinct candidates (u, v, held). First pass: of each text the pair with the first text of its cell, and with held
    true, u = v, the texts of which other pairs are withheld. Else: all pairs of texts of different classes."""
    most = farthest(CHECK, threshold)

    def pairs_of(a: int, b: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for lo in range(a, b, 256):
            hi = min(b, lo + 256)
            d = np.zeros((hi - lo, b - lo), np.uint16)
            for lane in range(code.shape[1]):
                d += np.bitwise_count(code[lo:hi, lane, None] ^ code[None, lo:b, lane])
            i, j = np.nonzero(d <= most)
            keep = i < j
            found.append((i[keep] + lo, j[keep] + lo))
        return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches):
            cell, key, ids, size, side = (chunk.column(c).to_numpy() for c in ("cell", "key", "id", "size", "side"))
            own = chunk.column("class").fill_null(-1).to_numpy()
            code = np.frombuffer(b"".join(chunk.column("code").to_pylist()), np.uint64).reshape(len(cell), -1)
            edges = np.flatnonzero(np.diff(cell)) + 1
            out = []
            for a, b in zip(np.append(0, edges).tolist(), np.append(edges, len(cell)).tolist()):
                if b - a < 2:
                    continue
                i, j = pairs_of(a, b, code)
                keep = (np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])) & (ids[i] != ids[j]) & (key[i] == key[j])
                if not first:
                    keep &= ((side[i] == 0) | (side[i] != side[j])) & (own[i] != own[j])
                i, j = i[keep], j[keep]
                if not first or not len(i):
                    out.append((ids[i], ids[j], np.zeros(len(i), np.int64)))
                    continue
                by = np.lexsort((i, j))
                i, j = i[by], j[by]
                lead = np.append(True, j[1:] != j[:-1])
                out.append((ids[i[lead]], ids[j[lead]], np.zeros(lead.sum(), np.int64)))
                held = ids[np.unique(np.concatenate([i[~lead], j[~lead]]))]
                out.append((held, held, np.ones(len(held), np.int64)))
            if out:
                u, v, held = (np.concatenate(c) for c in zip(*out))
                rows = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v), held], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2] == 1)], ["u", "v", "held"])

    # by id, so that different tables give the same pairs
    ordered = cells.select("cell", "key", "id", "size", "side", "class", "code").repartition("cell").sortWithinPartitions("cell", "id")
    return ordered.mapInArrow(run, "u long, v long, held boolean").distinct()


def _near(pairs: DataFrame, distinct: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose whole codes are near enough; only codes travel."""
    most = farthest(BITS, threshold)

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
        return batch.select(["u", "v"]).filter(pa.array(np.bitwise_count(a ^ b).sum(1) <= most))

    code = distinct.select("id", "code").where(F.col("size") > SHORT)
    both = pairs.join(code.select(F.col("id").alias("u"), F.col("code").alias("a")), "u").join(code.select(F.col("id").alias("v"), F.col("code").alias("b")), "v").select("u", "v", "a", "b")
    return map_arrow(both, "a", compare, "u long, v long")


def _packed(h: np.ndarray) -> bytes:
    """Sorted 64-bit hashes by their five leading bytes."""
    return np.ascontiguousarray(h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, 3:] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return np.unique(wide.view(">u8").ravel().astype(np.uint64))


def _exactly(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs that reach the threshold, of sets (id, size, hashes): a spanning forest of each cell's."""

    def prefixes(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, rows = [], []
        for row, data in enumerate(batch.column(2).to_pylist()):
            h = _unpacked(data)
            some = h[: len(h) - ceil(threshold * len(h) - 1e-9) + 1]
            keys.append(some.astype(np.int64))
            rows.append(np.full(len(some), row))
        rows = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(batch.column(i).take(rows) for i in range(3))], ["key", "id", "size", "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches):
            cell, ids, side = (chunk.column(c).to_numpy() for c in ("cell", "id", "side"))
            own = chunk.column("class").fill_null(-1).to_numpy()
            codes_ = chunk.column("code")
            edges = np.flatnonzero(np.diff(cell)) + 1
            out_u, out_v = [], []
            for a, b in zip(np.append(0, edges).tolist(), np.append(edges, len(cell)).tolist()):
                if b - a < 2:
                    continue
                members = [_unpacked(x.as_py()) for x in codes_[a:b]]
                for i, j in _reaching(members, ids[a:b], side[a:b], own[a:b], threshold):
                    out_u.append(min(ids[a + i], ids[a + j]))
                    out_v.append(max(ids[a + i], ids[a + j]))
            if out_u:
                yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], ["u", "v"])

    rows = map_arrow(sets.select("id", "size", "hashes"), "hashes", prefixes, "key long, id long, size int, code binary")

    def compared(cells: DataFrame) -> DataFrame:
        ordered = cells.select("cell", "id", "side", "class", "code").repartition("cell").sortWithinPartitions("cell", "id")
        return ordered.mapInArrow(run, "u long, v long").distinct()

    split = _split(rows)
    found = checkpointed(compared(_celled(rows, split)))
    return found if split.many == 0 else found.unionByName(compared(_parted(rows, split, components(found))))


def _reaching(sets: list[np.ndarray], ids: np.ndarray, side: np.ndarray, own: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (by position) that reach the threshold; common elements are counted by lists of who has each."""
    n = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = flat.argsort(kind="stable")
    held = owner[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = np.searchsorted(flat[order], flat)
    ends = np.cumsum(n)
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in range(1, len(sets)):
        mine = slice(ends[i] - n[i], ends[i])
        # those before i in each list
        many = place[mine] - first[mine]
        at = np.repeat(first[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        common = np.bincount(held[at], minlength=i)
        near = (common >= threshold * (n[i] + n[:i] - common)) & (ids[:i] != ids[i]) & ((side[:i] == 0) | (side[:i] != side[i]) & (own[:i] != own[i]))
        for j in np.flatnonzero(near).tolist():
            r, s = root(i), root(j)
            if r != s:
                parent[max(r, s)] = min(r, s)
                out.append((j, i))
    return out


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose shingle sets reach the threshold. Only the shingles of candidates travel."""
    involved = checkpointed(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct())
    involved = maybe_broadcast(involved, involved.count(), 16)

    def set_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([_packed(shingles(t)) for t in batch.column(1).to_pylist()], pa.binary())], ["id", "hashes"])

    sets = checkpointed(map_arrow(texts.join(involved, "id", "left_semi").select("id", "body"), "body", set_of, "id long, hashes binary"))

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            p, q = _unpacked(a), _unpacked(b)
            common = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(common >= threshold * (len(p) + len(q) - common))
        return batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("hashes").alias("b")), "v").select("u", "v", "a", "b")
    return map_arrow(both, "a", compare, "u long, v long")


def _sampled(distinct: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links of texts of more than SHORT shingles, by tables of sampled coordinates."""
    bits, tables = plan(distinct.where(F.col("size") > SHORT).count(), threshold)
    rows = _emit(distinct, bits, tables)
    split = _split(rows)

    def linked(pairs: DataFrame) -> DataFrame:
        return checkpointed(_verified(checkpointed(_near(pairs, distinct, threshold)), texts, threshold))

    found = checkpointed(_candidates(_celled(rows, split), threshold, True))
    links = linked(found.where("NOT held").select("u", "v"))
    held = found.where("held").select(F.col("u").alias("id"))
    n = held.count()
    if not n and not split.many:
        return links
    grouped = checkpointed(components(links))
    rest = distinct.join(maybe_broadcast(held, n, 16), "id", "left_semi")
    rest = rest.join(grouped.select(F.col("node").alias("id"), F.col("component").alias("class")), "id", "left").withColumn("class", F.coalesce("class", "id"))
    again = _candidates(_celled(_emit(rest, bits, tables), split), threshold, False)
    if split.many:
        again = again.unionByName(_candidates(_parted(rows, split, grouped), threshold, False)).distinct()
    return links.unionByName(linked(checkpointed(again.select("u", "v"))))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest id of the class), one row a document."""
    coded = stored(codes(docs, id_col, text_col, threshold))
    distinct = stored(coded.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("size").alias("size"), F.first("code").alias("code"), F.first("hashes").alias("hashes")))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    short = _exactly(distinct.where("hashes IS NOT NULL"), threshold)
    grouped = checkpointed(components(_sampled(distinct, texts, threshold).unionByName(short)))
    classed = coded.select("doc_id", "digest").join(distinct.select("digest", "id"), "digest").join(grouped.withColumnRenamed("node", "id"), "id", "left")
    single = docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return classed.select("doc_id", F.coalesce("component", "id").alias("class_id")).union(single)


def class_digest(docs: DataFrame) -> DataFrame:
    return classes(docs).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those of a class but its first; rows with null ids stay, and one of repeated rows.

    Only ids are brought together: texts travel if so many documents go that their ids can't be broadcast, or if ids are
    repeated, and then those rows only."""
    dropped = checkpointed(class_digest(docs).where(~F.col("kept")).select("doc_id").distinct())
    kept = docs.join(maybe_broadcast(dropped, dropped.count(), 16), "doc_id", "left_anti")
    repeated = checkpointed(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    n = repeated.count()
    if not n:
        return kept
    repeated = maybe_broadcast(repeated, n, 16)
    return kept.join(repeated, "doc_id", "left_anti").unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
