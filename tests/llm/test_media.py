import hashlib
import struct
import zlib

import numpy as np
import pytest
from docs import ROWS, awkward, empty

from vectorloom.llm import media


def test_digest_against_plain_python(spark):
    got = media.media_digest(awkward(spark)).collect()
    assert len(got) == len(ROWS)
    for row, (doc_id, text, *_) in zip(got, ROWS):
        data = (text or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert (row.doc_id, row.n_bytes, row.payload_bytes) == (doc_id, len(data), len(payload))
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert row.tail_crc32 == zlib.crc32(payload[-64:])
        assert row.media_sha256 == hashlib.sha256(media.write_png(payload)).hexdigest()
    assert media.media_digest(empty(spark)).count() == 0


def filtered(image, kinds):
    """An encoder by the letter of the PNG rules."""
    out = []
    for y, line in enumerate(image.astype(int)):
        up = image[y - 1].astype(int) if y else np.zeros(len(line), int)
        row = []
        for x, v in enumerate(line):
            a, b, c = (line[x - 1] if x else 0), up[x], (up[x - 1] if x else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((v - (0, a, b, (a + b) // 2, paeth)[kinds[y]]) % 256)
        out.append([kinds[y], *row])
    return np.array(out, np.uint8)


def test_all_filters_are_undone():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (40, 64), dtype=np.uint8)
    kinds = rng.integers(0, 5, 40).tolist()
    raw = filtered(image, kinds)
    assert (media.unfilter(raw[:, 0], raw[:, 1:]) == image).all()


@pytest.mark.parametrize("at", [20, 45, 60, -3])
def test_damage_is_noticed(at):
    data = bytearray(media.write_png(media.pad(b"some text " * 50)))
    data[at] ^= 1
    with pytest.raises((ValueError, struct.error, zlib.error)):
        media.read_png(bytes(data))


def test_hash_tells_texts_apart_but_not_copies():
    a, b = (media.read_png(media.write_png(media.pad(t))) for t in (b"alpha beta " * 400, b"Zebra! 0123 " * 400))
    assert media.cosine_hash(a) == media.cosine_hash(a.copy()) != media.cosine_hash(b)
