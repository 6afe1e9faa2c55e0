"""Merkle-tree fingerprints of documents: spans of words, paragraphs, sections, root.

Equal texts have equal roots. Where two roots differ, only the differing branches need be followed to find the edits.
Spans and sections end where the content says so, so an insertion moves the cuts near it only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, n_parts, text_or_empty

#: A span of words ends after a word whose hash is 0 modulo this; a section after a paragraph likewise.
SPAN, SECTION = 6, 4
#: A span of more bytes than this is cut further: behind strings of 8 bytes whose hash is 0 modulo CUT, or when it is full.
LONGEST, CUT = 256, 64
#: Bytes of a node's hash, of the root's, and of a leaf in a fingerprint string.
NODE, ROOT, LEAF = 8, 16, 3

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 14)
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each range; sums are the running sums of byte times power."""
    back = _power(len(raw) + 1)[1]
    return _mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


class Tree:
    """The tree of one text. leaves, sizes: hash and bytes of each span; offsets: its first byte; and the levels above."""

    def __init__(self, text: str):
        data = text.encode("utf-8", "surrogatepass")
        raw = np.frombuffer(data, np.uint8)
        n = len(raw)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(n + 1)[0][:n], out=sums[1:])
        newline = raw == 10
        gap = newline | (raw == 32)
        # Every byte belongs to a word and the blanks behind it; words end where a blank meets what is none.
        cuts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1 if n else np.zeros(0, np.int64)
        edges = np.concatenate([[0], cuts, [n]]) if n else np.zeros(1, np.int64)
        words = span_hashes(raw, edges[:-1], edges[1:], sums)
        lines = np.cumsum(newline)
        ends_line = lines[edges[1:] - 1] > np.where(edges[:-1] > 0, lines[edges[:-1] - 1], 0) if n else np.zeros(0, bool)
        last = (words % np.uint64(SPAN) == 0) | ends_line
        if n:
            last[-1] = True
        ends, stops = self._cut(raw, edges[1:][last], ends_line[last])
        self.offsets = np.concatenate([[0], ends[:-1]]) if n else ends
        self.sizes = ends - self.offsets
        self.leaves = span_hashes(raw, self.offsets, ends, sums)
        if n:
            stops[-1] = True
        self._build(np.flatnonzero(stops) + 1, n)

    @staticmethod
    def _cut(raw: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ends of spans, and whether a paragraph ends there, with long spans cut further."""
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        new: list[int] = []
        for a, b in zip(starts[ends - starts > LONGEST].tolist(), ends[ends - starts > LONGEST].tolist(), strict=True):
            x = raw[a:b].astype(np.uint64)
            h = x[:-7].copy()
            for i in range(1, 8):
                h |= x[i : len(x) - 7 + i] << np.uint64(8 * i)
            cuts, begin = a + 8 + np.flatnonzero(_mixed(h) % np.uint64(CUT) == 0), a
            for c in [*cuts[cuts < b].tolist(), b]:
                # What is too long still is cut when it is full.
                new += range(begin + LONGEST, c, LONGEST)
                new += [c] if c < b else []
                begin = c
        if not new:
            return ends, stops
        every = np.union1d(ends, new)
        is_stop = np.zeros(len(every), bool)
        is_stop[np.searchsorted(every, ends)] = stops
        return every, is_stop

    def _build(self, stops: np.ndarray, n: int) -> None:
        digest = lambda parts, size: hashlib.blake2b(parts, digest_size=size).digest()
        data, begin = self.leaves.tobytes(), 0
        #: Per paragraph: hash, first span, end; per section: hash, first paragraph, end.
        self.paragraphs, self.sections = [], []
        for stop in stops.tolist():
            self.paragraphs.append((digest(data[8 * begin : 8 * stop], NODE), begin, stop))
            begin = stop
        first = 0
        for i, (h, _, _) in enumerate(self.paragraphs):
            if h[0] % SECTION == 0 or i + 1 == len(self.paragraphs):
                self.sections.append((digest(b"".join(p[0] for p in self.paragraphs[first : i + 1]), NODE), first, i + 1))
                first = i + 1
        self.root = digest(b"".join(s[0] for s in self.sections) + n.to_bytes(8, "big"), ROOT)

    def fingerprint(self) -> str:
        """root:leaves, as hex; a leaf takes LEAF bytes."""
        short = np.ascontiguousarray(self.leaves.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, :LEAF]
        return f"{self.root.hex()}:{short.tobytes().hex()}"


def likeness(a: Tree, b: Tree) -> float:
    """Twice the bytes in common spans (as often as both have them) over the bytes of both; 1 if the roots are equal."""
    if a.root == b.root:
        return 1.0
    total = int(a.sizes.sum() + b.sizes.sum())
    if not len(a.leaves) or not len(b.leaves):
        return 0.0
    kinds, of = np.unique(np.concatenate([a.leaves, b.leaves]), return_inverse=True)
    in_a, in_b = np.bincount(of[: len(a.leaves)], minlength=len(kinds)), np.bincount(of[len(a.leaves) :], minlength=len(kinds))
    size = np.zeros(len(kinds), np.int64)
    size[of] = np.concatenate([a.sizes, b.sizes])
    return min(1.0, 2.0 * float((np.minimum(in_a, in_b) * size).sum()) / total)


def changed_ranges(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Byte ranges of b's text that a lacks, found from the root down: equal branches are not entered."""
    if a.root == b.root:
        return []
    sections, paragraphs, leaves = {s[0] for s in a.sections}, {p[0] for p in a.paragraphs}, set(a.leaves.tolist())
    out: list[tuple[int, int]] = []
    for h, first, end in b.sections:
        for p, begin, stop in b.paragraphs[first:end] if h not in sections else ():
            for i in range(begin, stop) if p not in paragraphs else ():
                if int(b.leaves[i]) not in leaves:
                    start, over = int(b.offsets[i]), int(b.offsets[i] + b.sizes[i])
                    if out and out[-1][1] == start:
                        out[-1] = (out[-1][0], over)
                    else:
                        out.append((start, over))
    return out


NODES = "level string, place long, hash string, first_child long, n_children long, start_byte long, n_bytes long"


def merkle_nodes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, level, place, hash, first_child, n_children, start_byte, n_bytes): every node of every text's tree.

    level is root, section, paragraph or span. Null counts as empty; an empty text is a root without children. Equal
    texts have equal nodes, repeated rows repeat them, null ids stay null. An empty table gives no rows.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ident, body in zip(pdf["id"].tolist(), pdf["body"].tolist(), strict=True):
                t = Tree(body)
                ends = t.offsets + t.sizes
                at = lambda i: int(t.offsets[i]) if i < len(t.offsets) else 0
                size = lambda i, j: int(ends[j - 1]) - at(i) if j > i else 0
                rows = [("root", 0, t.root.hex(), 0, len(t.sections), 0, size(0, len(ends)))]
                for k, (h, i, j) in enumerate(t.sections):
                    x, y = t.paragraphs[i][1], t.paragraphs[j - 1][2]
                    rows.append(("section", k, h.hex(), i, j - i, at(x), size(x, y)))
                rows += [("paragraph", k, h.hex(), i, j - i, at(i), size(i, j)) for k, (h, i, j) in enumerate(t.paragraphs)]
                rows += [("span", k, f"{h:016x}", 0, 0, at(k), size(k, k + 1)) for k, h in enumerate(t.leaves.tolist())]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")]).assign(id=ident)

    found = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("body")).mapInPandas(nodes, f"{NODES}, id {id_type}")
    return found.select(F.col("id").alias("doc_id"), *[c.split()[0] for c in NODES.split(", ")])


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


def _row(ident, text: str, tree: Tree, following: str, next_tree: Tree) -> tuple:
    changed = _edited(text, following)
    other = Tree(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return ident, len(text), sha, tree.fingerprint(), other.fingerprint(), likeness(tree, other), likeness(tree, next_tree)


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows for the documents of each range, sorted; a range ends with a guest, the document that follows its last."""
    last, names = None, [c.split()[0] for c in EDITED.split(", ")]
    for pdf in batches:
        rows = []
        for guest, ident, none, text in zip(*(pdf[c].tolist() for c in ("guest", "doc_id", "none", "text")), strict=True):
            if guest and last is None:
                continue  # another copy of the guest
            tree = Tree(text)
            if last is not None:
                rows.append(_row(*last, text, tree))
            last = None if guest else (None if none else ident, text, tree)
        out = pd.DataFrame(rows, columns=names)
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", docs_per_range: int = 4000) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness, next to that of the following document.

    The documents are taken in descending order of doc_id (a long), null last and after the last the first again. The
    edited text has its last floor(n / 3) code points replaced by the first as many, or all, of the following text. Ids
    are cut into ranges of about docs_per_range documents; the texts move once, to their range, and the first of each
    range also goes to the range before it. So no task sees more than its range and one document.

    Null and empty texts are empty: their edited texts are empty too. Rows that share an id follow one another by the
    hash of their texts. A single document follows itself. Equal texts have equal fingerprints and likeness 1. An empty
    table gives an empty one. Other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("doc_id"), F.col(doc_id).isNull().alias("none"), text_or_empty(text).alias("text"))
    bounds = _range_bounds(ids, docs_per_range)
    placed = ids.withColumns({"part": _place(bounds)("doc_id", "none"), "tie": F.xxhash64("text")})
    # A row for each range, so a few thousand at most: see MOST_RANGES.
    moved = placed.join(F.broadcast(_firsts(placed)), placed["part"] == F.col("of"), "left")
    is_first = (F.col("doc_id") == F.col("first_id")) & (F.col("none") == F.col("first_none")) & (F.col("tie") == F.col("first_tie"))
    own, guest = F.struct("part", F.lit(False).alias("guest")), F.struct(F.col("before").alias("part"), F.lit(True).alias("guest"))
    rows = moved.select("doc_id", "none", "tie", "text", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))).alias("to")).select("to.*", "doc_id", "none", "tie", "text")
    dealt = rows.repartition(max(n_parts(spark), len(bounds) + 2), "part").sortWithinPartitions("part", "guest", "none", F.desc("doc_id"), "tie", "text")
    return dealt.mapInPandas(_pairs, EDITED)


#: Ranges grow with the table beyond this number of them; the tasks stream, so their memory does not.
MOST_RANGES = 20_000


def _range_bounds(ids: DataFrame, docs_per_range: int) -> list[int]:
    """Descending ids that cut the table into ranges; one number for each docs_per_range documents."""
    n = min(MOST_RANGES, -(-ids.count() // docs_per_range))
    if n < 2:
        return []
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    return sorted(set(ids.where(~F.col("none")).agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 20 * n))).alias("b")).head()["b"] or []), reverse=True)


def _place(bounds: list[int]):
    """The range of an id, by binary search: ranges count from the largest ids, and null ids come last."""
    up = np.array(bounds[::-1], np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series, none: pd.Series) -> pd.Series:
        found = len(up) - np.searchsorted(up, ids.to_numpy(), side="left")
        return pd.Series(np.where(none.to_numpy(), len(up) + 1, found).astype("int32"))

    return place


def _firsts(placed: DataFrame) -> DataFrame:
    """For each range that has rows: its first document, and the range before it (for the first range, the last)."""
    # The largest of these is the first in the order: present id before null, larger before smaller, smaller hash first.
    key = F.struct((~F.col("none")).alias("has"), F.col("doc_id").alias("id"), F.bitwise_not("tie").alias("tie"))
    first = placed.groupBy("part").agg(F.max(key).alias("m")).select(F.col("part").alias("of"), F.col("m.id").alias("first_id"), (~F.col("m.has")).alias("first_none"), F.bitwise_not("m.tie").alias("first_tie"))
    order = W.orderBy("of")
    return first.withColumn("before", F.coalesce(F.lag("of").over(order), F.max("of").over(W.partitionBy())))
