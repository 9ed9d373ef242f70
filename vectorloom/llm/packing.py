"""Packing by concatenate and cut.

Pass one encodes every document once, keeps its ids as little-endian 16-bit (or 32-bit) numbers in a table in the
shared folder, and sums the tokens of each partition. The running sums of those totals (one row a partition) give every
document its global offset; pass two cuts the stream at multiples of the window, and a document that crosses a cut
yields one boundary record a window.

Words repeat far more often than texts, so each worker remembers the ids of what it has met between single spaces (a
bounded memory); the tokenizers library encodes those it hasn't, many in one call. A pre-token ends wherever a space
follows a character that is not white space, so such a stretch is encoded alike alone and within a text. A text is a
column of numbers of distinct stretches, and its ids are gathered by them (of marks behind a word apart); where spaces come in runs or beside other
white space, a stretch goes on up to the next space that follows a character. Only texts with a special token's own text
are encoded whole.

Defined results: a null text counts as empty and yields the end token alone; null ids and repeated rows are packed like
any other row; no rows, no pieces; other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from vectorloom.llm.common import kept, slices, small_batches, stored

WINDOW = 2048
END_ID = 1
#: Stretches that a worker remembers, and the most characters of one.
MEMORY, LONG = 600_000, 100
#: Bytes of text that are split at once, stretches that are encoded by one call, and ids that are gathered at once.
PIECE, CALL, GATHER = 4 << 20, 4000, 1 << 18
#: Units of a text: parted by each space that follows a character that no one takes for white space.
_UNITS = re.compile("(?<=[^\\s\x85\u180e]) ").split
#: What may be cut from the end of a word of these letters: it is a pre-token of its own.
_MARKS, _LETTERS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+$"
#: Ends of stretches behind which a space could belong to a token with that end; an empty stretch has none.
_OPEN = {"", "\x85", "\u180e", *(c for c in map(chr, range(1 << 16)) if c.isspace())}


class Memory:
    """A bounded table of what is known; when full, entries met in one piece only are forgotten first, then all."""

    def __init__(self, most: int):
        self.most, self.known, self.once = most, {}, set()

    def lacking(self, wanted: set) -> set:
        """Those that are to be learned now."""
        if len(self.once) > self.most // 2:
            for w in self.once - wanted:
                del self.known[w]
            self.once = set()
        if len(self.known) > self.most:
            self.known, self.once = {}, set()
        self.once -= wanted
        new = wanted.difference(self.known)
        self.once |= new
        return new


class Recent:
    """A bounded table of what is known; entries met in one piece only are forgotten first, then those not met for long."""

    def __init__(self, most: int):
        self.most, self.once, self.often, self.before = most, {}, {}, {}

    def __len__(self) -> int:
        return len(self.once.keys() | self.often.keys() | self.before.keys())

    def get(self, wanted: list[str], learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The values of distinct keys; ``learn`` gives those of keys that aren't known."""
        found = list(map(self.often.get, wanted))
        at = [i for i, v in enumerate(found) if v is None]
        keys = [wanted[i] for i in at]
        again = [v if o is None else o for v, o in zip(map(self.before.get, keys), map(self.once.get, keys))]
        new = [k for k, v in zip(keys, again) if v is None]
        learnt = learn(new) if new else []
        rest = iter(learnt)
        for i, v in zip(at, again):
            found[i] = next(rest) if v is None else v
        self.often.update([(k, v) for k, v in zip(keys, again) if v is not None])
        if len(self.often) > self.most // 3:
            self.often, self.before = {}, self.often
        if len(self.once) > self.most // 3:
            self.once = {}
        self.once.update([(k, v) for k, v in zip(new[: self.most // 3], learnt) if len(k) <= LONG])
        return found


class WordEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library by way of their distinct stretches."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # executors run a worker for each core
        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # stretches come once
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype(f"<u{array(self.code).itemsize}")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: ids of stretches behind a space (nothing if a space after it could be part of the same token), and of first ones
        self.stretches, self.heads, self.marks = Recent(MEMORY), Recent(MEMORY // 10), Recent(MEMORY // 10)
        #: ids of tokens that begin with a space
        self.leads = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.leads[i] = token[:1] == "\u0120"

    def _packed(self, ids: list[int]) -> bytes:
        found = array(self.code, ids)
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def _each(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), CALL):
            out += [self._packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts[at : at + CALL], add_special_tokens=False)]
        return out

    def _behind(self, units: list[str]) -> list[bytes]:
        """Ids of each behind a space. None is open."""
        out, width = [], self.dtype.itemsize
        for at in range(0, len(units), CALL):
            some = units[at : at + CALL]
            # in a row they are split as they were, and each begins with a space: its only one, if there are as many
            (found,) = self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)
            ids = np.array(found.ids, self.dtype)
            begin = np.flatnonzero(self.leads[ids])
            if len(begin) == len(some) and not begin[0]:
                data, edges = ids.tobytes(), [*(begin * width).tolist(), ids.nbytes]
                out += [data[a:b] for a, b in zip(edges, edges[1:])]
            else:
                out += self._each([" " + u for u in some])
        return out

    def _stretches(self, wanted: list[str]) -> list[bytes]:
        closed = iter(self._behind([s for s in wanted if s[-1:] not in _OPEN]))
        return [b"" if s[-1:] in _OPEN else next(closed) for s in wanted]

    def _values(self, names: pa.Array) -> list[bytes]:
        """Ids of distinct stretches behind a space: those of a word, and of the marks at its end, are looked up apart."""
        word = pc.utf8_rtrim(names, _MARKS)
        ends = pc.and_(pc.not_equal(pc.binary_length(word), pc.binary_length(names)), pc.match_substring_regex(word, _LETTERS))
        keys = pc.if_else(ends, word, names).dictionary_encode()
        found = self.stretches.get(_listed(keys.dictionary), self._stretches)
        values = [found[i] for i in keys.indices.to_numpy().tolist()]
        at = np.flatnonzero(np.asarray(ends)).tolist()
        marks = [n[len(w) :] for n, w in zip(_listed(names.filter(ends)), _listed(word.filter(ends)))]
        distinct = list(dict.fromkeys(marks))
        known = dict(zip(distinct, self.marks.get(distinct, self._each)))
        for i, m in zip(at, marks):
            values[i] += known[m]
        return values

    def _gathered(self, values: list[bytes], length: np.ndarray, index: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The values (of so many ids) that the index names, one after the other; a text begins at each of ``first``."""
        flat = np.frombuffer(b"".join(values), self.dtype)
        begin, length = (np.cumsum(length) - length)[index], length[index]
        end = np.cumsum(length)
        out, at = np.empty(int(end[-1]), self.dtype), 0
        while at < len(index):
            done = int(end[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(end, done + GATHER, "right")))
            part = length[at:to]
            where = np.repeat(begin[at:to] - (end[at:to] - part - done), part)
            where += np.arange(len(where))
            np.take(flat, where, out=out[done : done + len(where)], mode="clip")
            at = to
        data, edges = out.tobytes(), [*((end - length)[first] * self.dtype.itemsize).tolist(), out.nbytes]
        return [data[a:b] for a, b in zip(edges, edges[1:])]

    def _plain(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Ids of texts that have a single space between words, and which texts haven't."""
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        first = np.asarray(parts.offsets)[:-1]
        last = np.append(first[1:], len(parts.values)) - 1
        coded = parts.values.dictionary_encode()
        index, names = np.array(coded.indices), coded.dictionary
        values = self._values(names)
        # the first has no space before it, and none follows the last
        heads, own = np.unique(index[first], return_inverse=True)
        shut = np.fromiter(map(len, values), np.int64, len(values)) > 0
        inner = ~shut[index]
        odd = inner[first]
        tails, at = np.unique(index[last[inner[last]]], return_inverse=True)
        ends, inner[last] = last[inner[last]], False
        odd |= np.bitwise_or.reduceat(inner, first)
        index[ends] = len(values) + at
        values = values + self._each([" " + t for t in _listed(names.take(pa.array(tails)))])
        index[first] = len(values) + own
        values += self.heads.get(_listed(names.take(pa.array(heads))), self._each)
        length = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        return self._gathered(values, length, index, first), odd

    def _units(self, texts: list[str]) -> list[bytes]:
        """Ids of texts with any white space."""
        units = [_UNITS(t) for t in texts]
        inner = list(dict.fromkeys(u for p in units for u in p[1:-1]))
        known = dict(zip(inner, self.stretches.get(inner, self._behind)))
        heads = self._each([p[0] for p in units])
        tails = iter(self._each([" " + p[-1] for p in units if len(p) > 1]))
        return [b"".join([h, *map(known.__getitem__, p[1:-1]), next(tails) if len(p) > 1 else b""]) for h, p in zip(heads, units)]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if any(x in t for x in self.specials)]
        out = dict(zip(whole, self._each([texts[i] for i in whole])))
        rest = [i for i in range(len(texts)) if i not in out]
        if rest:
            found, odd = self._plain([texts[i] for i in rest])
            out.update(zip(rest, found))
            odd = [i for i, o in zip(rest, odd.tolist()) if o]
            out.update(zip(odd, self._units([texts[i] for i in odd])))
        return [out[i] for i in range(len(texts))]


def _listed(strings: pa.Array) -> list[str]:
    """As ``to_pylist``, several times as fast."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def encode_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``part``, ``first`` (tokens before it in its partition), ``n`` and ``ids`` as bytes, end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, encoder = TaskContext.get().partitionId(), 0, kept(("packing", path), lambda: WordEncoder(path))
        end = np.asarray([END_ID], encoder.dtype).tobytes()
        width = encoder.dtype.itemsize
        for batch in batches:
            for piece in slices(batch, "body", PIECE):
                ids = [x + end for x in encoder.encode([t or "" for t in piece.column(1).to_pylist()])]
                n = np.array([len(x) // width for x in ids], np.int64)
                first = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.full(len(n), part), pa.int32()), pa.array(first), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "part", "first", "n", "ids"])

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    return source.mapInArrow(run, "doc_id long, part int, first long, n long, ids binary")


def _begins(encoded: DataFrame) -> dict[int, int]:
    """The tokens before each partition: one row a partition of the scan, not of the data, reaches the driver."""
    begins, at = {}, 0
    for row in encoded.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        begins[row["part"]] = at
        at += row["n"]
    return begins


def _cut(encoded: DataFrame, window: int, last: str, kind: pa.DataType, make: Callable[[bytes], object]) -> DataFrame:
    """The pieces of the stream, with what ``make`` gives of each piece's ids (32-bit little-endian) as the last column."""
    shared = encoded.sparkSession.sparkContext.broadcast(_begins(encoded))
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [(last, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "ids"):
                rows: list[tuple] = []
                for doc, part, first, n, ids in zip(*(c.to_pylist() for c in piece.columns)):
                    words = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                    begin = shared.value[part] + first
                    done = 0
                    while done < n:
                        sequence, offset = divmod(begin + done, window)
                        length = min(n - done, window - offset)
                        rows.append((doc, done, length, n, sequence, offset, make(words[done : done + length].tobytes())))
                        done += length
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return encoded.select("doc_id", "part", "first", "n", "ids").mapInArrow(run, from_arrow_schema(schema))


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (32-bit little-endian bytes)."""
    return _cut(stored(encode_ids(docs, path)), window, "ids", pa.binary(), bytes)


def pieces_digest(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """The pieces with the checksum of their ids; the ids themselves don't travel."""
    cut = _cut(stored(encode_ids(docs, path)), window, "ids_crc32", pa.int64(), crc32)
    return cut.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
