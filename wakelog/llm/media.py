"""PNG media in binary columns: lossless storage of sample bytes, checked reading, and low-frequency cosine hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Fixed by the format: the first bytes of a PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in an image row.
WIDTH = 64
#: The image is averaged to SIDE x SIDE cells; LOW x LOW cosine coefficients are kept.
SIDE, LOW = 32, 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: np.ndarray, level: int = 1) -> bytes:
    """A greyscale image of 8-bit samples (rows x columns) as PNG; each row takes filter None or Up, the flatter one."""
    rows, cols = samples.shape
    up = samples.copy()
    up[1:] -= samples[:-1]
    use_up = (np.abs(up.astype(np.int8).astype(np.int16)).sum(1) * 4 < samples.sum(1, dtype=np.int64)).astype(np.uint8)
    lines = np.empty((rows, cols + 1), np.uint8)
    lines[:, 0] = use_up * 2
    lines[:, 1:] = np.where(use_up[:, None] == 1, up, samples)
    head = struct.pack(">IIBBBBB", cols, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    if data[:at] != SIGNATURE:
        raise ValueError("not a PNG file")
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body, crc = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(crc) < 4 or struct.unpack(">I", crc)[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        yield kind, body
        at += 12 + size


def _unfiltered(lines: np.ndarray) -> np.ndarray:
    """Undo the row filters of 8-bit greyscale lines (filter byte first). Runs of None, Sub and Up rows go at once."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown row filter")
    sub = kinds == 1
    out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(kinds, prepend=255, append=255))
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        if kinds[start] == 2:
            first = out[start - 1] if start else np.zeros(out.shape[1], np.uint8)
            out[start:end] = np.cumsum(np.vstack([first[None], out[start:end]]), axis=0, dtype=np.uint8)[1:]
        elif kinds[start] >= 3:
            for r in range(start, end):
                _predicted(out, r, kinds[start] == 3)
    return out


def _predicted(out: np.ndarray, r: int, average: bool) -> None:
    above = out[r - 1].astype(int) if r else np.zeros(out.shape[1], int)
    left = corner = 0
    for c, up in enumerate(above.tolist()):
        if average:
            guess = (left + up) // 2
        else:
            base = left + up - corner
            guess = min((left, up, corner), key=lambda v: abs(base - v))
        left, corner = (int(out[r, c]) + guess) & 255, up
        out[r, c] = left


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG without interlacing; ValueError if any chunk or the size is wrong."""
    head, body, ended = None, [], False
    for kind, part in _chunks(data):
        head = part if kind == b"IHDR" else head
        body += [part] if kind == b"IDAT" else []
        ended |= kind == b"IEND"
    if head is None or not ended:
        raise ValueError("the file is cut short")
    cols, rows, *form = struct.unpack(">IIBBBBB", head)
    if form != [8, 0, 0, 0, 0]:
        raise ValueError("only 8-bit greyscale without interlacing is read")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if lines.size != rows * (cols + 1):
        raise ValueError("the image data have another size than the header says")
    return _unfiltered(lines.reshape(rows, cols + 1))


#: The first LOW rows of the cosine transform of SIDE samples.
_COSINES = np.cos(np.pi / SIDE * (np.arange(SIDE) + 0.5)[None, :] * np.arange(LOW)[:, None])


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits as hex: which low-frequency cosine coefficients of the averaged image are over their median."""
    small = _averaged(_averaged(samples.astype(float)).T).T
    low = _COSINES @ small @ _COSINES.T
    bits = low.ravel() > np.median(low.ravel()[1:])
    return np.packbits(bits).tobytes().hex()


def _averaged(rows: np.ndarray) -> np.ndarray:
    """SIDE rows, each the mean of its share of the rows (of the one row it falls in, if there are fewer)."""
    n = len(rows)
    start = np.arange(SIDE) * n // SIDE
    end = np.maximum((np.arange(SIDE) + 1) * n // SIDE, start + 1)
    sums = np.vstack([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)])
    return (sums[end] - sums[start]) / (end - start)[:, None]


def payload(text: str | None) -> bytes:
    """UTF-8, with bytes 0 up to a positive multiple of the row width."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def store_as_png(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a binary column of PNG files that hold the texts' UTF-8 bytes as samples, 64 to a row.

    Null counts as empty; an empty text is one row of zeros. Equal texts give equal files, repeated rows repeated ones.
    Texts may have any length: a document is one file. An empty table gives an empty one. Other columns pass through;
    ValueError if one is named as the added one.
    """
    fresh(docs, media)

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: encode_png(np.frombuffer(payload(t), np.uint8).reshape(-1, WIDTH)))

    return docs.withColumn(media, encode(F.col(text)))


MEDIA_FIELDS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_png(media_docs: DataFrame, media: str = "media") -> DataFrame:
    """media_docs with the struct column read: size, hash and checksum of the samples read back, and the cosine hash.

    tail_crc32 is of the last 64 samples. A null file gives a null struct; a damaged one raises ValueError. Equal files
    give equal features. Other columns pass through; ValueError if one is named read.
    """
    fresh(media_docs, "read")

    @F.pandas_udf(MEDIA_FIELDS)
    def decode(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            samples = decode_png(data)
            raw = samples.tobytes()
            rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples)))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in MEDIA_FIELDS.split(", ")])

    return media_docs.withColumn("read", F.when(F.col(media).isNotNull(), decode(F.coalesce(F.col(media), F.lit(encode_png(np.zeros((1, WIDTH), np.uint8)))))))
