"""CSV text to long Arrow batches, column by column: no cell is looked at by Python."""

from __future__ import annotations

import csv
import zipfile
from collections.abc import Iterator
from typing import IO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.names import time_column

LONG = "source string, member string, row_ord long, col_ord int, signal string, t double, v double"
_FORM = pa.schema([("source", pa.string()), ("member", pa.string()), ("row_ord", pa.int64()), ("col_ord", pa.int32()), ("signal", pa.string()), ("t", pa.float64()), ("v", pa.float64())])
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Bytes of text that are parsed together.
CHUNK = 8 << 20


def csv_members(archive: str | IO[bytes], every: bool) -> list[str]:
    """The names of an archive's CSV members in their order: all of them or the first."""
    with zipfile.ZipFile(archive) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".csv")]
    return names if every else names[:1]


def numbers(cells: pa.Array) -> np.ndarray:
    """Texts as finite doubles; others are nan."""
    bare = pc.utf8_trim_whitespace(cells)
    plain = pc.if_else(pc.match_substring_regex(bare, _NUMBER), pc.utf8_ltrim(bare, "+"), None)
    v = plain.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.where(np.isfinite(v), v, np.nan)


def seconds(cells: pa.Array) -> np.ndarray:
    """Times as seconds: numbers, or three or four numbers parted by colons; others are nan."""
    t = numbers(cells)
    other = np.flatnonzero(np.isnan(t))
    parts = pc.split_pattern(pc.utf8_trim_whitespace(cells.take(pa.array(other))), ":")
    first, size, flat = parts.offsets.to_numpy()[:-1], np.diff(parts.offsets.to_numpy()), numbers(parts.flatten())
    for n in (3, 4):
        at = np.flatnonzero(size == n)
        t[other[at]] = sum(flat[first[at] + n - 1 - i] * k for i, k in enumerate((1, 60, 3600, 86400)[:n]))
    return t


def _chunks(f: IO[bytes]) -> Iterator[str]:
    """The text in pieces of whole lines."""
    rest = b""
    while piece := f.read(CHUNK):
        head, cut, tail = (rest + piece).rpartition(b"\n")
        if cut:
            yield head.decode("utf-8", "replace")
        rest = tail
    if rest:
        yield rest.decode("utf-8", "replace")


def _cells(text: str) -> tuple[np.ndarray, pa.Array]:
    """Where each line's cells begin, with the end of the last, and all cells in a row. Blank lines are left out."""
    if '"' in text:
        rows = [r for r in csv.reader(text.splitlines()) if r]
        return np.cumsum([0, *map(len, rows)]), pa.array([c for r in rows for c in r], pa.string())
    lines = pc.utf8_rtrim(pa.array(text.split("\n"), pa.string()), "\r")
    parts = pc.split_pattern(lines.filter(pc.not_equal(lines, "")), ",")
    return parts.offsets.to_numpy(), parts.flatten()


def long_batches(f: IO[bytes], source: str, member: str, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """LONG batches of a CSV file's finite cells in rows that have a time; of rows longer than the header the rest is left out.

    columns: headers that count, by their whole name or suffix; None is all. The first line is the header, in UTF-8 with
    replacement. ValueError without a time column. A file without a line gives nothing.
    """
    header, done = None, 0
    for text in _chunks(f):
        begins, cells = _cells(text)
        if header is None and len(begins) > 1:
            header, begins = cells[: begins[1]].to_pylist(), begins[1:]
            at = header.index(time_column(header))
            kept = [c for c, name in enumerate(header) if c != at and (columns is None or name in columns or name.split(".")[-1] in columns)]
        if header is None or len(begins) < 2:
            continue
        first, size = begins[:-1], np.diff(begins)
        t = np.full(len(first), np.nan)
        timed = np.flatnonzero(size > at)
        t[timed] = seconds(cells.take(pa.array(first[timed] + at)))
        for c in kept:
            rows = np.flatnonzero((size > c) & ~np.isnan(t))
            v = numbers(cells.take(pa.array(first[rows] + c)))
            rows, v = rows[~np.isnan(v)], v[~np.isnan(v)]
            if n := len(rows):
                same = [pa.array([x], k).take(pa.array(np.zeros(n, np.int64))) for x, k in ((source, pa.string()), (member, pa.string()), (c, pa.int32()), (header[c], pa.string()))]
                yield pa.RecordBatch.from_arrays([same[0], same[1], pa.array(done + rows), same[2], same[3], pa.array(t[rows]), pa.array(v)], schema=_FORM)
        done += len(first)
