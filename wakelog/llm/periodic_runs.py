"""Runs of periodic words by longest common extensions in suffix trees.

Ukkonen's trees of a word sequence and of its reversal, an Euler tour of each folded at its leaves, and a sparse table give
the common extension of two places to the right and to the left in constant time. Every run has a Lyndon root that is the
longest Lyndon word at its place under one of both orders of the words, so a candidate for each place and order, extended
in both directions, gives all runs.

Trees are built where runs can be. In a run of period q and at least 4 q words each word after the first q was there at most
q words before, and these are at least three quarters of the run. So stretches of words whose last occurrence is no
further back than a third of the stretch, and as much before them, hold every run whole; what is left out has none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: A run has this many words at least, and this many times its period.
SHORTEST, TIMES = 6, 4
#: Rounds of narrowing before the stretches that are left are taken as they are, and bytes of text looked at together.
NARROWINGS, CHUNK = 40, 4_000_000


def suffix_tree(s: list[int]) -> tuple[list[int], list[int], list[dict[int, int] | None]]:
    """Ukkonen's tree of s, whose last symbol is found nowhere else: start and end of each node's edge, and its children.

    Node 0 is the root; leaves have no children, and their edges end at len(s).
    """
    n = len(s)
    start, end, link, child = [0], [0], [0], [{}]
    node = edge = length = rest = 0
    for i, c in enumerate(s):
        rest += 1
        fresh_ = 0
        while rest:
            if not length:
                edge = i
            v = child[node].get(s[edge])
            if v is None:
                child[node][s[edge]] = len(start)
                start.append(i), end.append(n), link.append(0), child.append(None)
                if fresh_:
                    link[fresh_] = node
                    fresh_ = 0
            else:
                at = start[v]
                span = end[v] - at
                if length >= span:
                    edge, length, node = edge + span, length - span, v
                    continue
                if s[at + length] == c:
                    length += 1
                    if fresh_:
                        link[fresh_] = node
                    break
                middle = len(start)
                child[node][s[edge]] = middle
                start[v] = at + length
                start.append(at), end.append(at + length), link.append(0), child.append({c: middle + 1, s[at + length]: v})
                start.append(i), end.append(n), link.append(0), child.append(None)
                if fresh_:
                    link[fresh_] = middle
                fresh_ = middle
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - rest + 1
    return start, end, child


class CommonExtensions:
    """Longest common prefixes of any two suffixes of a sequence, and the order of the suffixes.

    rank: by ascending symbols. The end comes before any symbol.
    """

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        start, end, child = suffix_tree([*words.tolist(), -1])
        self.kids = kids = [None if c is None else [c[x] for x in sorted(c)] for c in child]
        self.ended = [c is not None and -1 in c for c in child]
        # The tour notes the parent's depth before each child, and the child's own.
        tour, leaves, self.leaves, stack = [], [], [], [(0, 0)]
        while stack:
            v, above = stack.pop()
            depth = above + end[v] - start[v]
            tour += (above, depth)
            if kids[v] is None:
                leaves.append(len(tour) - 1)
                self.leaves.append(v)
            else:
                stack.extend((w, depth) for w in reversed(kids[v]))
        tour, leaves = np.array(tour, np.int32), np.array(leaves)
        # Leaf k stands for the suffix that is as long as it is deep; the lone end is the first.
        self.suffixes = n + 1 - tour[leaves]
        self.rank = np.empty(n + 1, np.int64)
        self.rank[self.suffixes] = np.arange(n + 1)
        # Folded at the leaves: the least depth between two neighbours is that of their lowest common ancestor.
        table = np.minimum.reduceat(tour, leaves)[:-1] if n else np.zeros(0, np.int32)
        self.table = [table]
        while 2 << len(self.table) - 1 <= n:
            half = 1 << len(self.table) - 1
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The common prefix of the suffixes at i and at j, which differ; n is the empty one."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(hi - lo)[1] - 1
        out = np.zeros(len(lo), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][lo[at]], self.table[k][hi[at] - (1 << int(k))])
        return out

    def descending(self) -> np.ndarray:
        """Ranks of the suffixes by descending symbols, the end still first."""
        suffix, order, stack = dict(zip(self.leaves, self.suffixes.tolist(), strict=True)), [], [0]
        while stack:
            v = stack.pop()
            kids = self.kids[v]
            if kids is None:
                order.append(suffix[v])
            elif self.ended[v]:
                stack += (*kids[1:], kids[0])
            else:
                stack += kids
        rank = np.empty(self.n + 1, np.int64)
        rank[order] = np.arange(self.n + 1)
        return rank


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one of a smaller rank. The last place, the end, has the least."""
    out, open_ = np.empty(len(rank), np.int64), []
    for i, r in enumerate(rank.tolist()):
        while open_ and open_[-1][0] > r:
            out[open_.pop()[1]] = i
        open_.append((r, i))
    return out[:-1]


def runs_of(words: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of the runs of a sequence of numbers, by start and period.

    A run is a stretch with smallest period q, of at least max(shortest, times * q) words, times being 2 or more, that
    no word before or behind it extends.
    """
    n = len(words)
    if n < max(shortest, 2):
        return np.zeros((0, 3), np.int64)
    right, left = CommonExtensions(words), CommonExtensions(words[::-1])
    found = []
    for rank in (right.rank, right.descending()):
        # The longest Lyndon word at i ends before the next smaller suffix.
        i, j = np.arange(n), next_smaller(rank)
        inside = (j < n) & (times * (j - i) <= n)
        i, j = i[inside], j[inside]
        end, begin = j + right.of(i, j), i - left.of(n - i, n - j)
        long = end - begin >= np.maximum(shortest, times * (j - i))
        found.append(np.stack([begin, end - begin, j - i], axis=1)[long])
    found = np.unique(np.concatenate(found), axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def stretches(codes: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Places (from, to) that hold every run whole, united where they overlap; see the module's text.

    codes: the words of several documents one after the other, as numbers; doc: the number of each word's document.
    """
    order = np.lexsort((codes, doc))
    same = (codes[order][1:] == codes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    back = np.full(len(codes), np.iinfo(np.int64).max // TIMES)
    back[order[1:][same]] = np.diff(order)[same]
    at = np.flatnonzero(back <= len(codes))
    thirds, least = TIMES - 1, min(SHORTEST - 1, 2 * (TIMES - 1))
    for _ in range(NARROWINGS):
        # The first word of a document was never there before, so no stretch crosses documents.
        piece = np.cumsum(np.diff(at, prepend=-2) != 1) - 1
        size = np.bincount(piece)[piece] if len(at) else piece
        keep = (size >= least) & (thirds * back[at] <= size)
        if keep.all():
            break
        at = at[keep]
    if not len(at):
        return []
    begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    size = np.diff(begins, append=len(at))
    lo, hi = at[begins] - size // thirds, at[begins] + size
    lo = np.maximum(lo, np.searchsorted(doc, doc[at[begins]]))
    reach = np.maximum.accumulate(hi)
    of = doc[at[begins]]
    new = np.concatenate([[True], (lo[1:] > reach[:-1]) | (of[1:] != of[:-1])])
    return list(zip(lo[new].tolist(), np.maximum.reduceat(hi, np.flatnonzero(new)).tolist(), strict=True))


def runs_of_documents(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each document, given as its words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy()
    doc = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for lo, hi in stretches(codes, doc):
        d = int(doc[lo])
        a, b = int(first[d]), int(first[d] + sizes[d])
        for start, length, period in runs_of(codes[lo:hi]) + [lo, 0, 0]:
            end = start + length
            # What goes on beyond the stretch is the piece of a run that another stretch holds whole.
            cut = start == lo > a and codes[lo - 1] == codes[lo - 1 + period] or end == hi < b and codes[hi] == codes[hi - period]
            if not cut:
                found[d].append((start - a, length, period))
    return [np.array(sorted(set(f), key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3) for f in found]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    return [w for w, d in zip(words, np.cumsum(drop).tolist(), strict=False) if not d] if len(runs) else words


def with_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words as the query's contract has them: every tenth document ends in a repeated stretch, by its id's checksum.

    Documents without an id stay as they are.
    """
    h, n = 1 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _row(words: list[bytes], runs: np.ndarray) -> tuple:
    listed = b"".join(b"%d,%d,%d\n" % tuple(r) for r in runs.tolist())
    best = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
    chosen = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(runs), *chosen, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest())


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """docs' ids with n_runs, the longest run (start, length, period, exponent_milli), runs_sha256 and collapsed_sha256.

    Words are runs of anything but space and U+0009 to U+000D. See runs_of for what a run is (here at least 6 words
    and 4 periods). Of equally long runs the one with the smallest start, then period, is told; without runs these columns
    are null. runs_sha256 is over all runs as lines start,length,period; collapsed_sha256 over the words left when each
    run is cut to its first period, joined by a space. prepare may change a document's words first.

    Texts are read whole, in batches of bounded bytes; a document is one unit of work. Null and empty texts have no words.
    Repeated rows have a row each, null ids stay null, and an empty table gives an empty one. No other column is read, so none clashes; ValueError if
    the id's column bears the name of an added one.
    """
    kept = docs.select(doc_id, text)
    fresh(kept.select(doc_id), *(c.split()[0] for c in SCHEMA.split(", ")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, raw = b[doc_id].to_pylist(), b[text].cast(pa.binary()).to_pylist()
            rows, at = [], 0
            while at < len(ids):
                begin, size = at, 0
                while at < len(ids) and (at == begin or size + len(raw[at] or b"") <= CHUNK):
                    size += len(raw[at] or b"")
                    at += 1
                words = [(x or b"").split() for x in raw[begin:at]]
                if prepare:
                    words = [prepare(i, w) for i, w in zip(ids[begin:at], words, strict=True)]
                rows += [_row(w, r) for w, r in zip(words, runs_of_documents(words), strict=True)]
            columns = [b[doc_id], *(pa.array(c, pa.string() if i > 4 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True)))] if rows else None
            if columns:
                yield pa.RecordBatch.from_arrays(columns, [doc_id, *(c.split()[0] for c in SCHEMA.split(", "))])

    return kept.mapInArrow(find, f"`{doc_id}` {kept.schema[doc_id].dataType.simpleString()}, {SCHEMA}")
