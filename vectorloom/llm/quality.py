"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn; at each turn a shallow tree (a few bins apart, here the best single cut into up
to ``LEAVES`` runs of quantile bins) is fitted to the logistic gradients and added, shrunk, to that feature's lookup
table. Then the pairs of features with the most left to explain are boosted alike over their two-dimensional tables. A
score is the sum of one table entry a feature and a pair: vectorised bin additions.

The model is fitted on at most ``SAMPLE`` labelled documents, chosen by a hash of the id among those whose
crc32(doc_id as text) modulo 5 is not 0. Inputs are measurements of the text alone.

Defined results: null and empty texts get the measurements of an empty text and a score like any other; with no labels,
or one class only, every score is the smoothed share of label 1; several labels of one document all count; rows with
null labels or ids aren't learned from; repeated rows score alike; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import map_arrow

SAMPLE = 20_000
BINS, PAIR_BINS, LEAVES = 32, 8, 3
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 120, 40, 6, 0.1
THRESHOLD = 0.3

FEATURES = (
    "log_words", "mean_word", "long_words", "distinct_words", "top_word", "bigram_repeat", "upper", "digits", "punctuation",
    "odd_symbols", "spaces", "newlines", "line_repeat", "short_words", "mean_sentence", "entropy", "bang", "pipe", "longest_word", "caps_words",
    "adjacent_repeat", "marked_words",
)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.zeros(256, bool)
_ODD[[ord(c) for c in "#$%&*@^~|<>{}[]\\=+_`"]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def measure(text: str | None) -> np.ndarray:
    """The features of one text, from its bytes and the hashes of its words."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    out = np.zeros(len(FEATURES))
    n = len(data)
    if not n:
        return out
    count = np.bincount(data, minlength=256)
    solid = ~_SPACE[data]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    w = len(begin)
    out[6] = count[65:91].sum() / n
    out[7] = count[48:58].sum() / n
    out[8] = (count[33:48].sum() + count[58:65].sum()) / n
    out[9] = count[_ODD].sum() / n
    out[10] = count[_SPACE].sum() / n
    out[11] = count[10] / n
    share = count[count > 0] / n
    out[15] = -(share * np.log2(share)).sum()
    out[16] = count[33] / n
    out[17] = count[124] / n
    if not w:
        return out
    size = end - begin
    # a hash of each word's first 64 bytes and length
    place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n))) if begin[0] == 0 else None
    if place is None:
        place = np.arange(n) - np.concatenate([np.zeros(begin[0], np.int64), np.repeat(begin, np.diff(np.append(begin, n)))])
    term = data * _POWERS[np.minimum(place, 63)] * (solid & (place < 64))
    word = np.add.reduceat(term, begin) ^ size.astype(np.uint64)
    _, times = np.unique(word, return_counts=True)
    out[0] = np.log1p(w)
    out[1] = size.mean()
    out[2] = (size > 12).mean()
    out[3] = len(times) / w
    out[4] = times.max() / w
    if w > 1:
        pairs = word[:-1] * np.uint64(31) + word[1:]
        out[5] = 1 - len(np.unique(pairs)) / len(pairs)
        out[20] = (word[1:] == word[:-1]).mean()
    lines = [x for x in (text or "").split("\n") if x]
    out[12] = 1 - len(set(lines)) / max(1, len(lines))
    out[13] = (size <= 3).mean()
    out[14] = w / (1 + count[_END].sum())
    out[18] = np.log1p(size.max())
    first, second = data[begin], data[np.minimum(begin + 1, n - 1)]
    out[19] = ((first >= 65) & (first <= 90) & (second >= 65) & (second <= 90) & (size > 1)).mean()
    last = data[end - 1]
    out[21] = (~_LETTER[last] & ~((last >= 44) & (last <= 63))).mean()
    return out


@dataclass
class Model:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not self.edges:
            return out
        at = [e.searchsorted(x[:, j], "right") for j, e in enumerate(self.edges)]
        for a, t in zip(at, self.tables):
            out += t[a]
        for i, j, t in self.pairs:
            out += t[self.coarse[i][at[i]], self.coarse[j][at[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Newton steps of the best greedy cut of consecutive bins into so many runs."""
    runs, value = [(0, len(g))], np.zeros(len(g))
    cg, ch = np.append(0.0, np.cumsum(g)), np.append(0.0, np.cumsum(h))
    gain_of = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    while len(runs) < leaves:
        best = (1e-9, None, None)
        for r, (a, b) in enumerate(runs):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = gain_of(a, cut) + gain_of(cut, b) - gain_of(a, b)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], r, int(cut[k]))
        if best[1] is None:
            break
        a, b = runs.pop(best[1])
        runs += [(a, best[2]), (best[2], b)]
    for a, b in runs:
        value[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return value


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    n, ones = len(y), float(np.sum(y))
    model = Model(float(np.log((ones + 1) / (n - ones + 1))))
    if n < 20 or ones in (0, n):
        return model
    for j in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
        model.edges.append(cuts)
        bins = len(cuts) + 1
        model.tables.append(np.zeros(bins))
        model.coarse.append(np.arange(bins) * PAIR_BINS // bins)
    at = [e.searchsorted(x[:, j], "right") for j, e in enumerate(model.edges)]
    f = np.full(n, model.base)

    def gradients():
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, a in enumerate(at):
            g, h = gradients()
            step = RATE * _tree(np.bincount(a, g, len(model.tables[j])), np.bincount(a, h, len(model.tables[j])), LEAVES)
            model.tables[j] += step
            f += step[a]
    wide = [c[a] for c, a in zip(model.coarse, at)]
    g, h = gradients()
    gains = []
    for i in range(len(at)):
        for j in range(i):
            cell = wide[i] * PAIR_BINS + wide[j]
            cg, ch = np.bincount(cell, g, PAIR_BINS**2), np.bincount(cell, h, PAIR_BINS**2)
            gains.append(((cg**2 / (ch + 5)).sum(), i, j, cell))
    gains.sort(key=lambda t: -t[0])
    chosen = [(i, j, cell, np.zeros(PAIR_BINS**2)) for _, i, j, cell in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, cell, table in chosen:
            g, h = gradients()
            step = RATE * np.bincount(cell, g, PAIR_BINS**2) / (np.bincount(cell, h, PAIR_BINS**2) + 5)
            table += step
            f += step[cell]
    model.pairs = [(i, j, table.reshape(PAIR_BINS, PAIR_BINS)) for i, j, _, table in chosen]
    return model


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every row."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.stack([measure(t) for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel()))], ["doc_id", "x"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("body")), "body", kernel, "doc_id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("double").alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    rows = measured(docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")).dropDuplicates(["doc_id", "x"]).join(chosen, "doc_id").collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.x))
    return fit(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([float(r.y > 0) for r in rows]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.stack([measure(t) for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(rows))], ["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("body")), "body", kernel, "doc_id long, score double")


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    p = predict(docs, train(docs, labels))
    return p.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
