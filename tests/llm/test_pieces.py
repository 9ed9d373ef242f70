import numpy as np
import pytest
from docs import ROWS, awkward, empty

from vectorloom.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")


def ids_of(row):
    return None if row.ids is None else np.frombuffer(row.ids, "<u4").tolist()


def test_awkward_texts(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    encoded = pieces.encode_pieces(awkward(spark), PATH)
    for row, (doc_id, text, *_) in zip(encoded.collect(), ROWS):
        assert row.doc_id == doc_id and row.parity and row.round_trip
        assert ids_of(row) == (None if text is None else sp.encode(text))
    assert [r.text for r in pieces.decode_pieces(encoded, PATH).collect()] == [r[1] for r in ROWS]
    assert pieces.pieces_digest(empty(spark), PATH).count() == 0


def test_whole_text_parity(spark, small):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    text = dict(map(tuple, docs.select("doc_id", "text").collect()))
    for row in pieces.encode_pieces(docs, PATH).collect():
        assert ids_of(row) == sp.encode(text[row.doc_id])


def test_full_tokenizer_agrees():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    t = pieces.backend(pieces.parse_model(PATH))
    for text in ("Hello  world", " lead", "tab\tand\nline", "naïve 日本 \U0001f600", "a" * 300):
        assert t.encode(text, add_special_tokens=False).ids == sp.encode(text)


def test_unigram_model(tmp_path):
    """A unigram model written here byte by byte, since tokenizers aren't trained."""
    import struct

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    def message(number, body):
        return varint(number << 3 | 2) + varint(len(body)) + body

    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    listed += [(p, -float(s), 1) for s, p in enumerate(("▁", "a", "b", "ab", "▁ab", "ba", "aba"), 1)]
    data = b"".join(message(1, message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + varint(k)) for p, s, k in listed)
    data += message(2, b"\x18\x01" + varint(35 << 3) + b"\x01") + message(3, b"\x18\x01\x20\x00\x28\x01")
    path = tmp_path / "uni.model"
    path.write_bytes(data)
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    c = pieces.Codec(str(path))
    for text in ("ab abab ba", "abxba \n ab", "  ab"):
        ids, parity = c.encode([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(text) and parity
        assert c.decode(np.frombuffer(ids, "<u4")) == text


def test_a_normalising_model_is_compared_text_by_text(tmp_path):
    """The model's own normaliser flag: runs of spaces become one; parity is then asked for whole texts."""
    data = open(PATH, "rb").read()
    m = pieces.parse_model(PATH)
    path = tmp_path / "extra.model"
    # a later field of a message overrides: the normaliser with remove_extra_whitespaces on
    path.write_bytes(data + b"\x1a\x02\x20\x01")
    assert not m.remove_extra and pieces.parse_model(str(path)).remove_extra
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    c = pieces.Codec(str(path))
    for text in ("a  b", " lead and trail ", "plain words"):
        ids, same = c.encode([text])[0]
        assert same == (np.frombuffer(ids, "<u4").tolist() == sp.encode(text))
    c.oracle = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert not c.encode(["a  b"])[0][1]


def test_runs_of_spaces_and_odd_texts(monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = ["a  b", " a", "a ", "  ", " ", "x \n  y", "if x:\n    return  y\n", "a\0b  c", "\0", "l\u2581x y", "plain words here", "plain words  here", ""]
    monkeypatch.setattr(pieces, "MEMORY", 4)
    c = pieces.Codec(PATH)
    for _ in range(3):
        for text, (ids, same) in zip(texts, c.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == sp.encode(text) and same, text


def test_unlike_chunks_are_reported(monkeypatch):
    c = pieces.Codec(PATH)
    real = c._expected
    monkeypatch.setattr(c, "_expected", lambda chunks: [[7] if "odd" in x else y for x, y in zip(chunks, real(chunks))])
    assert [same for _, same in c.encode(["an odd one", "another", "two  odd"])] == [False, True, False]
    assert [same for _, same in c.encode(["odd", "another"])] == [False, True]
