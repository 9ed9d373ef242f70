import zlib

import numpy as np
import pytest
from docs import ROWS, awkward, empty

from vectorloom.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def direct(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*e.ids, 1] for e in t.encode_batch(texts, add_special_tokens=False)]


def check(pieces, texts):
    """Every id in exactly one piece, sequences without gaps, at most the last one short."""
    ids = dict(zip([t[0] for t in texts], direct([t[1] or "" for t in texts])))
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault(p.doc_id, []).append(p)
        want = np.asarray(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()
        assert p.ids_crc32 == zlib.crc32(want) and p.doc_tokens == len(ids[p.doc_id])
    for s, spans in by_sequence.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at == packing.WINDOW or s == max(by_sequence) and at < packing.WINDOW
    return by_doc


def test_awkward_texts(spark):
    by_doc = check(packing.pieces_digest(awkward(spark).repartition(3), PATH).collect(), ROWS)
    assert {k: sum(p.length for p in v) for k, v in by_doc.items()} == {d: len(x) * (2 if d == 6 else 1) for (d, *_), x in zip(ROWS, direct([r[1] or "" for r in ROWS]))}
    assert packing.pieces_digest(empty(spark), PATH).count() == 0


def test_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    by_doc = check(packing.pieces_digest(docs.repartition(5), PATH).collect(), rows)
    assert len(by_doc) == len(rows)
    for p in packing.pack(docs.repartition(5), PATH).collect():
        assert np.frombuffer(p.ids, "<u4").size == p.length


def test_pretokens_of_odd_characters():
    e = packing.WordEncoder(PATH)
    texts = ["x² ½ Ⅷ a\x1cb \x85 c", "don't  stop\n\n \t it's_a __ 12,5 ٣٤ naïve e\u0301", " \u3000 wide\xa0space", "a\x1fb", "’s 's'S"]
    texts += ["hello <|endoftext|> world and", "  a b", "a  b c", "a \n b c", "one two\n three four", "a b ", "a b c\n", "a\xa0 b c", "x\x85 y z", "\n\n a b\n\nc d ", "\U0001d400 \U0001f600 bold x", "a\u180e b c"]
    for _ in range(2):
        for got, want in zip(e.encode(texts), direct(texts)):
            assert np.frombuffer(got, e.dtype).tolist() == want[:-1]


def test_forgetting_changes_nothing(monkeypatch, small):
    import pyarrow.parquet as pq

    monkeypatch.setattr(packing, "MEMORY", 300)
    e = packing.WordEncoder(PATH)
    texts = [t or "" for t in pq.read_table(f"{small}/documents.parquet").column("text").to_pylist()]
    for at in range(0, len(texts), 7):
        for got, want in zip(e.encode(texts[at : at + 7]), direct(texts[at : at + 7])):
            assert np.frombuffer(got, e.dtype).tolist() == want[:-1]


class Counting:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, 0

    def encode(self, text, **options):
        self.given += len(text)
        return self.tokenizer.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.given += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_known_words_are_not_encoded_again():
    e = packing.WordEncoder(PATH)
    words = [f"w{'abcdefghij'[i % 10] * (i % 7 + 1)}{'xyz'[i % 3] * (i // 21)}" for i in range(400)]
    texts = [s.join(words) for s in (" ", "  ", " \n ", ", ", "... ")]
    e.encode(texts)
    e.tokenizer = Counting(e.tokenizer)
    for got, want in zip(e.encode(texts), direct(texts)):
        assert np.frombuffer(got, e.dtype).tolist() == want[:-1]
    assert e.tokenizer.given < 0.02 * sum(map(len, texts))


def test_long_stretches_are_not_remembered():
    import pickle

    e = packing.WordEncoder(PATH)
    texts = [f"a {'ab%d' % i * 5000} b" for i in range(100)]
    for got, want in zip(e.encode(texts), direct(texts)):
        assert np.frombuffer(got, e.dtype).tolist() == want[:-1]
    assert len(pickle.dumps(vars(e.stretches))) < 10_000
