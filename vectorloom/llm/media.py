"""Media columns: texts kept losslessly as 8-bit grey PNG files, read back with checksum tests, and hashed.

``encode_media`` turns each text into a PNG image 64 samples wide; ``read_png`` parses such a file again (chunk
checksums, zlib stream, all five row filters undone with numpy) and ``cosine_hash`` takes the low frequencies of its
two-dimensional cosine transform.

Defined results: a null text counts as empty; an empty text becomes one row of 64 zero bytes; repeated rows and
null ids yield one row each; other columns of the input are not looked at.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import map_arrow

WIDTH = 64
SIDE, LOW = 32, 8
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_BASIS = np.cos(np.pi * (2 * np.arange(SIDE)[None, :] + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the width."""
    return data + b"\0" * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def write_png(payload: bytes, level: int = 3) -> bytes:
    """An 8-bit grey PNG of the payload. Each row is filtered by None, Sub or Up, whichever has the least absolute sum."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    options = (rows, sub, up)
    cost = np.stack([np.minimum(x, (0 - x).astype(np.uint8)).sum(1, dtype=np.int64) for x in options])
    kind = cost.argmin(0).astype(np.uint8)
    body = np.empty((len(rows), WIDTH + 1), np.uint8)
    body[:, 0] = kind
    for k, x in enumerate(options):
        body[kind == k, 1:] = x[kind == k]
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG without interlacing. Raises ValueError on a wrong signature, checksum or size."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, head, ended = 8, [], None, False
    while at < len(data) and not ended:
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if len(part) != n or at + 12 + n > len(data) or zlib.crc32(part, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"checksum or length of chunk {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended = kind == b"IEND"
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("unsupported or unfinished PNG")
    width, height = head[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if raw.size != height * (width + 1):
        raise ValueError("size of the image data")
    raw = raw.reshape(height, width + 1)
    return unfilter(raw[:, 0], raw[:, 1:])


def unfilter(kind: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undoes PNG's row filters. Runs of rows of one kind are undone together, but for Average and Paeth."""
    out = rows.copy()
    sub = kind == 1
    if sub.any():
        out[sub] = np.cumsum(rows[sub], 1, dtype=np.uint8)
    if not (kind >= 2).any():
        return out
    edges = np.flatnonzero(np.diff(kind)) + 1
    for a, b in zip([0, *edges], [*edges, len(kind)]):
        above = out[a - 1] if a else np.zeros(rows.shape[1], np.uint8)
        if kind[a] == 2:
            out[a:b] = above + np.cumsum(rows[a:b], 0, dtype=np.uint8)
        elif kind[a] in (3, 4):
            for y in range(a, b):
                up, left, corner, line = (out[y - 1] if y else np.zeros(rows.shape[1], np.uint8)).tolist(), 0, 0, rows[y].tolist()
                for x, u in enumerate(up):
                    if kind[y] == 3:
                        guess = (left + u) >> 1
                    else:
                        p = left + u - corner
                        d = (abs(p - left), abs(p - u), abs(p - corner))
                        guess = left if d[0] <= d[1] and d[0] <= d[2] else u if d[1] <= d[2] else corner
                    left, corner = (line[x] + guess) & 255, u
                    line[x] = left
                out[y] = line
        elif kind[a] > 4:
            raise ValueError(f"row filter {kind[a]}")
    return out


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8x8 lowest frequencies of the 32x32 mean image exceed their median (the constant one apart)."""
    height, width = image.shape
    wide = image.reshape(height, SIDE, width // SIDE).sum(2, dtype=np.int64) if width % SIDE == 0 else image[:, np.arange(SIDE) * width // SIDE].astype(np.int64)
    if height >= SIDE:
        at = np.arange(SIDE) * height // SIDE
        small = np.add.reduceat(wide, at, axis=0) / np.diff([*at, height])[:, None]
    else:
        small = wide[np.arange(SIDE) * height // SIDE].astype(np.float64)
    low = np.round(_BASIS @ small @ _BASIS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_bytes`` of the text, ``media`` (PNG), ``payload`` read back out of it, ``phash`` (8 bytes)."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, media, back, hashes = [], [], [], []
        for data in batch.column(1).to_pylist():
            data = data or b""
            png = write_png(pad(data))
            image = read_png(png)
            n.append(len(data))
            media.append(png)
            back.append(image.tobytes())
            hashes.append(cosine_hash(image))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(back, pa.binary()), pa.array(hashes, pa.binary())], ["doc_id", "n_bytes", "media", "payload", "phash"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    return map_arrow(source, "body", kernel, "doc_id long, n_bytes long, media binary, payload binary, phash binary")


def media_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, derived from the media and payload columns with built-in functions."""
    m = encode_media(docs)
    return m.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("phash")).alias("feature"),
    )
