"""Language identification by interpolated Kneser-Ney character models, one a language.

Texts are lowered, runs of anything but letters become one space, and each text gets spaces at both ends. Of every
language, character strings of ``ORDER`` are counted on the executors in a bounded sample of its labelled texts, whole
(about ``SAMPLE`` texts over all languages, in equal shares: those whose hashed id lies below the language's share of
the hash range); only the distinct strings with their counts reach the driver. Lower orders use continuation counts
(how many characters precede a string). The probabilities, already interpolated, lie in sorted arrays of 64-bit string
hashes, one row a string with one logarithm a language; a second array holds the back-off weights of contexts. A
text's score under a language is its mean cross-entropy in bits a character; the lowest wins.

Rejection is calibrated on as many other labelled texts, on which nothing is counted: their cross-entropies give each
language's mean and deviation, the deviation shrinking with the text's length as measured there, and a text is
rejected where it lies further above its language's mean, in deviations, than all but a share ``FALSE_REJECTION`` of
the calibration texts of all languages (at least ``LEAST_DEVIATIONS``, for samples too small to show that share). Of a
language with fewer than ``FEW`` labelled texts everything is counted; its texts are cut into ``FOLDS`` parts, each is
calibrated by a model of the other parts, and as such parts say little about other texts, its limit lies ``FEW_BITS``
above the mean besides.

Defined results: a null text or one without letters is ``und`` with score 0 and rejected; ties go to the first language
in sorted order; rows without a language or id aren't learned from, but null ids are predicted; with nothing to learn
from, every text is ``und``; repeated rows are predicted alike; other columns are not looked at, and ``annotate``
replaces columns that have the names of its results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import kept, maybe_broadcast, slices, small_batches

ORDER = 4
#: Texts that are counted, and as many that calibrate, over all languages.
SAMPLE = 6000
#: A language with fewer labelled texts is calibrated by parts of those that are counted.
FEW, FOLDS = 40, 5
#: Share of texts of learned languages that may be rejected, and limits that hold besides (see above).
FALSE_REJECTION, LEAST_DEVIATIONS, FEW_BITS = 0.001, 8.0, 3.25
#: Code points that are counted or scored at once.
AT_ONCE = 400_000
#: Bits that one character costs at most (unknown characters).
UNKNOWN_BITS = 16.0
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@cache
def _kinds() -> np.ndarray:
    """By code point: 2 of letters, 1 of marks, 0 of all else."""
    import regex

    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    out = np.zeros(len(every), np.uint8)
    for pattern, kind in ((r"\p{M}+", 1), (r"\p{L}+", 2)):
        for found in regex.finditer(pattern, every):
            out[found.start() : found.end()] = kind
    return out


def code_points(text: str) -> np.ndarray:
    """Lower-case letters and single spaces, with a space at either end; empty if there is no letter."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), "<u4")
    kinds = _kinds()[codes]
    if not (kinds == 2).any():
        return np.empty(0, np.uint32)
    solid = kinds > 0
    # of what lies between words, the first character becomes the space
    taken = solid.copy()
    taken[1:] |= solid[:-1]
    taken[0] = True
    return np.where(solid, codes, np.uint32(32))[taken]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def string_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of each string of so many code points; element i is the string that begins at i."""
    n = len(codes) - order + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(order):
        h = (h + codes[k : k + n].astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
        h ^= h >> np.uint64(32)
    return mixed(h)


class SortedHashes:
    """A sorted array of hashes with a table of where each leading bit pattern begins."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = max(1, int(np.ceil(np.log2(max(2, len(hashes))))) + 1)
        self.shift = np.uint64(64 - self.bits)
        self.begin = np.searchsorted(hashes >> self.shift, np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.begin).max()) if len(hashes) else 0

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The position of each hash, -1 where it is absent."""
        out = np.full(len(wanted), -1, np.int32)
        if not len(self.hashes):
            return out
        at = self.begin[(wanted >> self.shift).astype(np.int64)]
        left = np.arange(len(wanted))
        last = len(self.hashes) - 1
        for _ in range(self.most):
            here = self.hashes[np.minimum(at, last)]
            hit = here == wanted[left]
            out[left[hit]] = at[hit]
            go = ~hit & (here < wanted[left])
            if not go.any():
                break
            left, at = left[go], at[go] + 1
        return out


@dataclass
class Model:
    languages: list[str]
    order: int
    #: by order 1..order: hashes and rows of log2 probabilities, one column a language
    strings: list[np.ndarray]
    logs: list[np.ndarray]
    #: by context length 1..order-1: hashes and rows of log2 back-off weights
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    #: by language: mean bits of calibration texts, variance a character, variance between texts, least bits above the mean
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    between: np.ndarray | None = None
    least: np.ndarray | None = None
    #: deviations above the mean beyond which a text is rejected
    limit: float = LEAST_DEVIATIONS

    def deviations(self, bits: np.ndarray, sizes: np.ndarray, language: np.ndarray) -> np.ndarray:
        return (bits - self.mean[language]) / np.sqrt(self.between[language] + self.spread[language] / sizes)


def count_strings(texts: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of so many code points (rows of a matrix) and their counts. No string runs into another text."""
    lead = np.full(order - 2, 32, np.uint32)
    texts = [np.concatenate([lead, t]) for t in texts]
    codes, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    starts = np.flatnonzero(left >= order)
    _, first, n = np.unique(string_hashes(codes, order)[starts], return_index=True, return_counts=True)
    return codes[starts[first][:, None] + np.arange(order)], n


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = (h + rows[:, k].astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
        h ^= h >> np.uint64(32)
    return mixed(h)


def kneser_ney(rows: np.ndarray, n: np.ndarray) -> tuple[list, list]:
    """Of one language's distinct strings and their counts: by order (hashes, probabilities) of strings, and by context length (hashes, weights).

    p(w | h) = max(c(hw) - D, 0) / c(h.) + D N1+(h.) / c(h.) p(w | h'), with continuation counts below the highest
    order, D = n1 / (n1 + 2 n2), and at order 1 a uniform share for unknown characters."""
    levels: list[tuple[np.ndarray, np.ndarray]] = [(rows, n)]
    for _ in range(rows.shape[1] - 1):
        longer = levels[0][0]
        rows, n = _distinct(longer[:, 1:])
        levels.insert(0, (rows, n))
    strings, contexts = [], []
    lower: tuple[np.ndarray, np.ndarray] | None = None
    for k, (rows, n) in enumerate(levels, 1):
        once, twice = int((n == 1).sum()), int((n == 2).sum())
        d = once / (once + 2 * twice) if once and twice else 0.5
        d = min(max(d, 0.1), 0.9)
        if k == 1:
            total = n.sum()
            p = (n - d) / total + d * len(n) / total * 2.0**-UNKNOWN_BITS
        else:
            heads, inverse = np.unique(_row_hashes(rows[:, :-1]), return_inverse=True)
            total = np.bincount(inverse, weights=n)
            weight = d * np.bincount(inverse) / total
            tails = lower[0].searchsorted(_row_hashes(rows[:, 1:]))
            p = (n - d) / total[inverse] + weight[inverse] * lower[1][tails]
            contexts.append((heads, weight))
        h = _row_hashes(rows)
        by = h.argsort()
        lower = (h[by], p[by])
        strings.append(lower)
    return strings, contexts


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each occurs: of distinct longer strings, the continuation counts."""
    _, first, n = np.unique(_row_hashes(rows), return_index=True, return_counts=True)
    return rows[first], n


def _stacked(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The union of the languages' hashes, and a column of values each (NaN where absent)."""
    hashes = np.unique(np.concatenate([h for h, _ in parts]))
    table = np.full((len(hashes), len(parts)), np.nan)
    for j, (h, v) in enumerate(parts):
        table[hashes.searchsorted(h), j] = v
    return hashes, table


@dataclass
class Counts:
    """Distinct strings and counts by language and part: part -1 is all of it; languages of few texts have parts besides."""

    order: int
    parts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = field(default_factory=dict)
    few: set[str] = field(default_factory=set)

    def without(self, language: str, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all parts of a language but one; of all of it, if there is no other."""
        some = [x for k, x in self.parts[language].items() if k not in (-1, part)] or [self.parts[language][-1]]
        rows = np.concatenate([r for r, _ in some])
        _, first, inverse = np.unique(_row_hashes(rows), return_index=True, return_inverse=True)
        return rows[first], np.bincount(inverse, weights=np.concatenate([n for _, n in some])).astype(np.int64)

    def model(self) -> Model:
        languages = sorted(self.parts)
        return _model(languages, [kneser_ney(*self.parts[x][-1]) for x in languages], self.order) if languages else Model([], self.order, [], [], [], [])

    def judges(self) -> dict[tuple[str, int], Model]:
        """For languages of few texts: by part, a model of the other parts."""
        return {(x, k): _model([x], [kneser_ney(*self.without(x, k))], self.order) for x in sorted(self.few & set(self.parts)) for k in self.parts[x] if k >= 0}


def text_parts(codes: np.ndarray) -> list[np.ndarray]:
    """A text cut into FOLDS parts of about as many words."""
    gaps = np.flatnonzero(codes == 32)
    at = gaps[np.unique(np.arange(FOLDS + 1) * (len(gaps) - 1) // FOLDS)]
    return [codes[a : b + 1] for a, b in zip(at, at[1:])]


def counted(rows: list[tuple[str, bool, str]], order: int) -> Counts:
    """Counts of (language, whether it has few texts, text)."""
    out, texts = Counts(order), defaultdict(list)
    for name, few, text in rows:
        codes = code_points(text)
        if len(codes):
            texts[name, -1].append(codes)
            if few:
                out.few.add(name)
                for k, part in enumerate(text_parts(codes)):
                    texts[name, k].append(part)
    for (name, k), some in texts.items():
        out.parts.setdefault(name, {})[k] = count_strings(some, order)
    return out


def scored(rows: list[tuple[str, bool, str]], scorer: Scorer, judges: dict[tuple[str, int], Scorer]) -> list[tuple[str, int, float]]:
    """(language, number of code points, bits a character under it) of calibration texts, or their parts."""
    out, place = [], {x: j for j, x in enumerate(scorer.model.languages)}
    for name, few, text in rows:
        codes = code_points(text)
        if len(codes) and name in place:
            for k, part in enumerate(text_parts(codes)) if few else [(0, codes)]:
                bits = judges[name, k].bits([part])[0, 0] if few else scorer.bits([part])[0, place[name]]
                out.append((name, len(part), float(bits)))
    return out


def calibrate(model: Model, few: set[str], found: list[tuple[str, int, float]]) -> Model:
    """Sets each language's mean and deviations, and the limit that all but a share FALSE_REJECTION of texts keep."""
    count = len(model.languages)
    model.mean, model.spread, model.between, model.least = np.full(count, np.nan), np.ones(count), np.ones(count), np.zeros(count)
    by = defaultdict(list)
    for name, n, bits in found:
        by[name].append((n, bits))
    for j, name in enumerate(model.languages):
        if by[name]:
            n, bits = np.array(by[name], float).T
            model.mean[j] = np.average(bits, weights=n)
            # robust against foreign and broken texts among the labelled ones
            model.between[j] = max(0.02, float(np.median(np.abs(bits - model.mean[j])))) ** 2 * 2.2
            model.spread[j] = max(1.0, float(np.median((bits - model.mean[j]) ** 2 * n)) * 2.2)
        model.least[j] = FEW_BITS if name in few else 0.0
    # a language without any calibration text is judged like the others
    rest = np.isnan(model.mean)
    if rest.any():
        model.mean[rest] = np.nanmean(model.mean) if not rest.all() else UNKNOWN_BITS / 2
        model.least[rest] = FEW_BITS
    place = {x: j for j, x in enumerate(model.languages)}
    many = [(place[name], n, bits) for name, n, bits in found if name not in few]
    if many:
        j, n, bits = (np.array(c) for c in zip(*many))
        z = np.sort(model.deviations(bits, n, j))
        model.limit = max(LEAST_DEVIATIONS, float(z[min(len(z) - 1, int(np.ceil((len(z) + 1) * (1 - FALSE_REJECTION))) - 1)]))
    return model


def fit(samples: dict[str, list[str]], order: int = ORDER) -> Model:
    """The model of texts by language, in this process; every fifth text calibrates where a language has many."""
    rows = [(name, len(texts) < FEW, i, t) for name, texts in samples.items() for i, t in enumerate(texts)]
    counts = counted([(name, few, t) for name, few, i, t in rows if few or i % 5], order)
    model = counts.model()
    if not model.languages:
        return model
    judges = {k: Scorer(m) for k, m in counts.judges().items()}
    return calibrate(model, counts.few, scored([(name, few, t) for name, few, i, t in rows if few or i % 5 == 0], Scorer(model), judges))


def _model(languages: list[str], fitted: list[tuple[list, list]], order: int) -> Model:
    contexts, weights = [], []
    for k in range(order - 1):
        h, t = _stacked([f[1][k] for f in fitted])
        contexts.append(h)
        weights.append(np.where(np.isnan(t), 0.0, np.log2(t, where=t > 0, out=np.zeros_like(t))).astype(np.float32))
    strings, logs = [], []
    for k in range(order):
        h, t = _stacked([f[0][k] for f in fitted])
        strings.append(h)
        logs.append(t)
    # -inf marks a string that a language lacks: scoring then backs off
    logs = [np.where(np.isnan(t), -np.inf, np.log2(t, where=t > 0, out=np.zeros_like(t))).astype(np.float32) for t in logs]
    return Model(languages, order, strings, logs, contexts, weights)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.strings = [SortedHashes(h) for h in model.strings]
        self.contexts = [SortedHashes(h) for h in model.contexts]
        # absent strings and contexts are found in the last row
        self.logs = [np.append(x, np.full((1, x.shape[1]), -np.inf, np.float32), axis=0) for x in model.logs]
        self.lacks = [np.isinf(x).any(axis=1) for x in self.logs]
        self.weights = [np.append(x, np.zeros((1, x.shape[1]), np.float32), axis=0) for x in model.weights]

    def bits(self, codes: list[np.ndarray]) -> np.ndarray:
        """Cross-entropy in bits a character, a row a text and a column a language; texts must not be empty."""
        m = self.model
        lead = np.full(m.order - 2, 32, np.uint32)
        joined = np.concatenate([x for c in codes for x in (lead, c)] + [np.full(m.order, 32, np.uint32)])
        sizes = np.array([len(c) for c in codes])
        begins = np.cumsum(sizes + len(lead)) - (sizes + len(lead))
        n = sizes - 1  # the first space is given
        # the string that ends at each predicted character, by its first position
        starts = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if len(starts) <= 2 * AT_ONCE:
            total = np.add.reduceat(self._logs(joined, starts, m.order), np.cumsum(n) - n, axis=0)
        else:  # a very long text: in blocks
            total, owner = np.zeros((len(codes), len(m.languages))), np.repeat(np.arange(len(codes)), n)
            for at in range(0, len(starts), AT_ONCE):
                np.add.at(total, owner[at : at + AT_ONCE], self._logs(joined, starts[at : at + AT_ONCE], m.order))
        return -total / n[:, None]

    def _logs(self, joined: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
        """log2 p of the last of k characters after the others, for the strings at the given positions."""
        h = np.zeros(len(starts), np.uint64)
        whole = len(starts) * 8 > len(joined)  # most places are wanted: hash all, in order
        if whole:
            h = np.zeros(len(joined) - k + 1, np.uint64)
        for j in range(k):
            if j == k - 1 and k > 1:
                head = h.copy()
            h += joined[j : j + len(h)] if whole else joined[starts + j]
            h += np.uint64(1)
            h *= _MULTIPLIER
            h ^= h >> np.uint64(32)
        at = self.strings[k - 1].find(mixed(h[starts] if whole else h))
        out = self.logs[k - 1].take(at, axis=0, mode="wrap")
        lacking = np.flatnonzero(self.lacks[k - 1][at])
        if not len(lacking):
            return out
        part = out[lacking]
        if k == 1:
            part[np.isinf(part)] = -UNKNOWN_BITS
        else:
            shorter = self._logs(joined, starts[lacking] + 1, k - 1)
            where = self.contexts[k - 2].find(mixed(head[starts[lacking]] if whole else head[lacking]))
            shorter += self.weights[k - 2].take(where, axis=0, mode="wrap")
            part = np.where(np.isinf(part), shorter, part)
        out[lacking] = np.maximum(part, -2 * UNKNOWN_BITS)
        return out


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sampled(docs: DataFrame, sample: int) -> DataFrame:
    """lang, few, learn (whether the text is counted, or calibrates), text of the labelled texts chosen by hashed id."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    per = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    languages = per.count()
    share = max(1, sample // max(1, languages))
    few = F.col("n") < FEW
    learn = F.when(few, F.lit(1.0)).otherwise(F.least(F.lit(0.75), share / F.col("n")))
    per = per.select("lang", few.alias("few"), learn.alias("learn"), F.when(few, F.lit(1.0)).otherwise(F.least(F.lit(1.0), learn + share / F.col("n"))).alias("take"))
    at = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = labelled.select("lang", "text", at.alias("at")).join(maybe_broadcast(per, languages, 64), "lang").where("at < take")
    return rows.select("lang", "few", (F.col("at") < F.col("learn")).alias("learn"), F.col("text").cast("string").alias("text"))


def _rows(piece: pa.RecordBatch) -> list[tuple[str, bool, str]]:
    return list(zip(*(c.to_pylist() for c in piece.columns)))


def _count_on_executors(rows: DataFrame, order: int) -> Counts:
    """Map-side counted, added up by string; what the driver gets is bounded by the sample's distinct strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", AT_ONCE * 4):
                found = counted(_rows(piece), order)
                for name, parts in found.parts.items():
                    for k, (strings, n) in parts.items():
                        texts = [x.tobytes().decode("utf-32-le") for x in np.ascontiguousarray(strings.astype("<u4"))]
                        size = len(n)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * size, pa.string()), pa.array([name in found.few] * size), pa.array(np.full(size, k, np.int32)), pa.array(texts, pa.string()), pa.array(n, pa.int64())], ["lang", "few", "part", "string", "n"])

    small_batches(rows.sparkSession)
    partial = rows.where("learn").select("lang", "few", "text").mapInArrow(run, "lang string, few boolean, part int, string string, n long")
    table = partial.groupBy("lang", "few", "part", "string").agg(F.sum("n").alias("n")).orderBy("lang", "part", "string").toArrow()
    out = Counts(order)
    codes = np.frombuffer("".join(table.column("string").to_pylist()).encode("utf-32-le"), "<u4").reshape(-1, order) if len(table) else np.empty((0, order), np.uint32)
    names, parts, few = table.column("lang").to_pylist(), table.column("part").to_pylist(), table.column("few").to_pylist()
    n = table.column("n").to_numpy()
    begin = 0
    for end in range(1, len(names) + 1):
        if end == len(names) or (names[end], parts[end]) != (names[begin], parts[begin]):
            out.parts.setdefault(names[begin], {})[parts[begin]] = (codes[begin:end], n[begin:end])
            if few[begin]:
                out.few.add(names[begin])
            begin = end
    return out


def _score_on_executors(rows: DataFrame, model: Model, judges: dict[tuple[str, int], Model]) -> list[tuple[str, int, float]]:
    """Three numbers a calibration text reach the driver."""
    shared, key = rows.sparkSession.sparkContext.broadcast((model, judges)), ("calibration", uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, own = kept(key, lambda: (Scorer(shared.value[0]), {k: Scorer(m) for k, m in shared.value[1].items()}))
        for batch in batches:
            for piece in slices(batch, "text", AT_ONCE * 4):
                found = scored(_rows(piece), scorer, own)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.float64()))], ["lang", "n", "bits"])

    table = rows.where("few OR NOT learn").select("lang", "few", "text").mapInArrow(run, "lang string, n long, bits double").toArrow()
    shared.unpersist()
    return list(zip(*(table.column(c).to_pylist() for c in ("lang", "n", "bits"))))


def train(docs: DataFrame, sample: int = SAMPLE, order: int = ORDER) -> Model:
    """Fits on about ``sample`` labelled texts and calibrates on as many others, both read where they lie."""
    rows = _sampled(docs, sample)
    counts = _count_on_executors(rows, order)
    model = counts.model()
    return calibrate(model, counts.few, _score_on_executors(rows, model, counts.judges())) if model.languages else model


RESULTS = ["lang_pred", "score", "bits", "rejected"]


def annotate(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of the input but those of these names, and lang_pred, score (0 to 1), bits, rejected."""
    small_batches(docs.sparkSession)
    shared, key = docs.sparkSession.sparkContext.broadcast(model), ("language", uuid4().hex)

    @F.arrow_udf("lang_pred string, score double, bits double, rejected boolean")
    def judged(column: pa.Array) -> pa.Array:
        scorer, m = kept(key, lambda: Scorer(shared.value)), shared.value
        texts = column.to_pylist()
        names, scores, bits, rejected = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)

        def judge(some: list[tuple[int, np.ndarray]]) -> None:
            found = scorer.bits([c for _, c in some])
            best = found.argmin(1)
            n = np.array([len(c) for _, c in some], float)
            # the posterior of equally likely languages, tempered by the root of the length
            odds = np.exp2(-(found - found.min(1, keepdims=True)) * np.sqrt(n)[:, None])
            share = 1 / odds.sum(1)
            low = found[np.arange(len(found)), best]
            out = (m.deviations(low, n, best) > m.limit) & (low > m.mean[best] + m.least[best])
            for k, (i, _) in enumerate(some):
                names[i], scores[i], bits[i], rejected[i] = m.languages[best[k]], float(share[k]), float(low[k]), bool(out[k])

        if m.languages:
            todo, size = [], 0
            for i, text in enumerate(texts):
                codes = code_points(text) if text else ()
                if len(codes):
                    if todo and size + len(codes) > AT_ONCE:
                        judge(todo)
                        todo, size = [], 0
                    todo.append((i, codes))
                    size += len(codes)
            if todo:
                judge(todo)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64()), pa.array(rejected)], RESULTS)

    # else a filter on a result would have every text judged twice
    judged = judged.asNondeterministic()
    others = [c for c in docs.columns if c not in (*RESULTS, "language_found")]
    return docs.select(*others, judged(F.col(text_col).cast("string")).alias("language_found")).select(*others, "language_found.*")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), bits, rejected of every row."""
    return annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("body")), model, "body").drop("body")


def language_digest(docs: DataFrame) -> DataFrame:
    p = predict(docs, train(docs))
    return p.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
