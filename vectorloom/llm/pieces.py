"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model file (a protobuf) is parsed here: pieces with scores and kinds, the model type, the normaliser and its flags.
Unigram models become a Unigram lattice over the piece scores; merge models become a BPE whose merges are all splits of
each piece into two pieces, ranked by the piece's score. Byte fallback and the metaspace marker are rebuilt as well.

No piece has a marker after another character, and a newline is no part of any piece of such a model (both are tested
when the model is loaded), so a text's encoding is the concatenation of its chunks' encodings. Each worker encodes the
distinct chunks it hasn't met in multithreaded batches (as many threads as a task has cores), compares each with what
the sentencepiece library makes of it, and remembers both the ids and the outcome (a bounded memory that forgets rare
chunks first, so that frequent ones aren't encoded and compared again).

Defined results: a null text yields null ids and n_tokens 0; an empty text yields no ids; repeated rows and null ids
are rows like any other; other columns are not looked at.
"""

from __future__ import annotations

import os
import struct
import sys
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import kept, map_arrow
from vectorloom.llm.packing import Memory

MARK = "▁"
ALONE = "\0"
#: Chunks that a worker remembers, and chunks that are encoded at once.
MEMORY, AT_ONCE = 800_000, 4000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)


def _fields(data: bytes):
    """(number, wire type, value) of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    unigram: bool = True
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True


def parse_model(path: str) -> Model:
    m = Model()
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    if v not in (1, 2):
                        raise ValueError(f"model type {v} is neither unigram nor BPE")
                    m.unigram = v == 1
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n in (3, 4, 5):
                    setattr(m, ("dummy_prefix", "remove_extra", "escape")[n - 3], bool(v))
    return m


def backend(m: Model, bare: bool = False):
    """A tokenizers.Tokenizer of the model; bare: without normaliser, for chunks."""
    from tokenizers import Regex, Tokenizer, models, normalizers

    unk = next(i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN)
    if m.unigram:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=unk, byte_fallback=m.byte_fallback)
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        usable = {p for p, _, k in m.pieces if k in (NORMAL, USER)}
        merges = []
        for p, s, k in m.pieces:
            if k in (NORMAL, USER):
                merges += [(-s, vocab[p], vocab[p[:i]], p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
        core = models.BPE(vocab, [x[3:] for x in sorted(merges)], unk_token=m.pieces[unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(core)
    if not bare:
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.remove_extra:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        if m.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        if m.escape:
            steps.append(normalizers.Replace(" ", MARK))
        t.normalizer = normalizers.Sequence(steps)
    return t


class Codec:
    def __init__(self, path: str):
        import regex
        import sentencepiece

        from pyspark import TaskContext

        task = TaskContext.get()
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(task.cpus() if task else os.cpu_count())
        self.model = m = parse_model(path)
        body = [p for p, _, k in m.pieces if k in (NORMAL, USER)]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in body) or not m.dummy_prefix or not m.escape:
            raise ValueError("a piece crosses a marker or a newline: chunks can't be encoded apart")
        self.tokenizer = backend(m, bare=True)
        self.normaliser = backend(m).normalizer
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # chunks come once
        self.plain = not m.charsmap and not m.remove_extra
        self.oracle = sentencepiece.SentencePieceProcessor(model_file=path)
        self.split = regex.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+").findall
        self.chunks = Memory(MEMORY)
        #: remembered chunks of which the library gives other ids
        self.unequal: set[str] = set()
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(MARK, " ").encode() for p, _, k in m.pieces]

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return MARK + text.replace(" ", MARK) if self.plain else self.normaliser.normalize_str(text)

    def _expected(self, chunks: list[str]) -> list[list[int]]:
        """The library's ids of each chunk. It adds a marker itself; a chunk without one is set behind a newline."""
        asked = [c[1:].replace(MARK, " ") if c[0] == MARK else "\n" + c for c in chunks]
        # the lone marker can't be asked for as an empty text
        found = self.oracle.encode([a or "\n" for a in asked], num_threads=1)
        head = len(self.oracle.encode("\n")) if chunks else 0
        return [f[: 1 if not a else None] if c[0] == MARK else f[head:] for c, a, f in zip(chunks, asked, found)]

    def _learn(self, wanted: set[str]) -> None:
        """Ids of chunks: what stands behind a single marker, or behind a null character the chunk as it is."""
        new, known = self.chunks.lacking(wanted), self.chunks.known
        self.unequal &= known.keys()
        todo = []
        for s in new:
            if s[:1] == ALONE:
                todo.append((s, s[1:]))
            elif not s or MARK in s:
                known[s] = None
            else:
                todo.append((s, MARK + s))
        for at in range(0, len(todo), AT_ONCE):
            some = todo[at : at + AT_ONCE]
            chunks = [c for _, c in some]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
            for (s, _), got, want in zip(some, ids, self._expected(chunks) if self.plain else ids):
                known[s] = _packed(got)
                if got != want:
                    self.unequal.add(s)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Ids as little-endian 32-bit numbers, and whether the sentencepiece library gives the same: asked chunk by chunk,
        or text by text if the model's normaliser changes more than spaces."""
        fast, slow, out = {}, {}, [(b"", True)] * len(texts)
        for i, t in enumerate(texts):
            if t and self.plain and ALONE not in t:
                fast[i] = t.split(" ")
            elif t:
                slow[i] = self._apart(t)
        for parts in (fast, slow):
            self._learn(set().union(*parts.values()))
            known = self.chunks.known.__getitem__
            for i, p in parts.items():
                try:
                    ids = b"".join(map(known, p))
                except TypeError:  # runs of spaces
                    slow[i] = self._apart(texts[i])
                    continue
                same = not self.unequal or self.unequal.isdisjoint(p)
                out[i] = (ids, same if self.plain else _packed(self.oracle.encode(texts[i])) == ids)
        return out

    def _apart(self, text: str) -> list[str]:
        return [ALONE + c for c in self.split(self.normalise(text))]

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return (data[1:] if self.model.dummy_prefix and data[:1] == b" " else data).decode("utf-8", "replace")


def _packed(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


def codec(path: str) -> Codec:
    """One a worker process."""
    return kept(("pieces", path), lambda: Codec(path))


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian 32-bit), parity (the sentencepiece library agrees), round_trip (decoding gives the text)."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        texts = batch.column(1).to_pylist()
        found = c.encode([t or "" for t in texts])
        back = [c.decode(np.frombuffer(ids, "<u4")) for ids, _ in found]
        ids = [None if t is None else f[0] for t, f in zip(texts, found)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([f[1] for f in found]), pa.array([(t or "") == b for t, b in zip(texts, back)])], ["doc_id", "ids", "parity", "round_trip"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    return map_arrow(source, "body", kernel, "doc_id long, ids binary, parity boolean, round_trip boolean")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of ``encode_pieces``' ids; null for null."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if i is None else c.decode(np.frombuffer(i, "<u4")) for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), "ids", kernel, "doc_id long, text string")


def pieces_digest(docs: DataFrame, path: str) -> DataFrame:
    e = encode_pieces(docs, path)
    return e.select("doc_id", F.coalesce(F.octet_length("ids") / 4, F.lit(0)).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "parity", "round_trip")
