"""Removal of byte strings that repeat across documents, by suffix arrays over shards built with induced sorting.

Every window of ``width`` bytes has an anchor: a string of ANCHOR bytes at a place that the smallest hash in the window
names. Equal windows have equal anchors, so windows can only repeat where anchors do. Anchors are brought together by
hash, each with a hash of its context (all bytes that a window with that anchor may have). Equal contexts are one, held by
the smallest document, as equal texts are: both hashes must agree, 128 bits. Where one anchor has different contexts, the
contexts themselves are sharded by anchor; in a shard those of an anchor are one string, whose suffix array and permuted
common prefixes tell which windows are equal, and the smallest document with each. A context is searched once, at its
first place in its smallest document; what is found there is carried to its further places in that document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_parts, stored, text_or_empty
from .fingerprints import _mixed, _power, span_hashes

WIDTH, ANCHOR = 50, 28
#: Bytes that may stand in front of an anchor in its windows, or behind it; bytes that are hashed to place anchors.
REACH, SEED = WIDTH - ANCHOR, 5
#: Bytes of contexts that make a shard: more anchors are added until it is full.
SHARD = 1_000_000


def suffix_array(s: list[int], top: int) -> list[int]:
    """The suffix array of s by induced sorting. s ends in 0, its only 0; values go up to top. Linear in len(s)."""
    n = len(s)
    if n == 1:
        return [0]
    # Types: a suffix is smaller than the next one (1) or larger (0).
    small = bytearray(n)
    small[n - 1] = 1
    for i in range(n - 2, -1, -1):
        if s[i] < s[i + 1] or (s[i] == s[i + 1] and small[i + 1]):
            small[i] = 1
    counts = [0] * (top + 2)
    for c in s:
        counts[c + 1] += 1
    for c in range(top + 1):
        counts[c + 1] += counts[c]
    heads, tails = counts[: top + 1], counts[1 : top + 2]
    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]

    def induce(order: list[int]) -> list[int]:
        sa, at = [-1] * n, tails[:]
        for i in reversed(order):
            c = s[i]
            at[c] -= 1
            sa[at[c]] = i
        at = heads[:]
        for i in range(n):
            j = sa[i] - 1
            if j >= 0 and not small[j]:
                c = s[j]
                sa[at[c]] = j
                at[c] += 1
        at = tails[:]
        for i in range(n - 1, -1, -1):
            j = sa[i] - 1
            if j >= 0 and small[j]:
                c = s[j]
                at[c] -= 1
                sa[at[c]] = j
        return sa

    # Sort the leftmost-smaller substrings, name them, and sort their sequence of names by recursion.
    end_of = dict(zip(lms, [*lms[1:], n - 1], strict=True))
    names, name, last = {}, -1, None
    for i in induce(lms):
        if i in end_of:
            piece = s[i : end_of[i] + 1]
            if piece != last:
                name, last = name + 1, piece
            names[i] = name
    reduced = [names[i] for i in lms]
    if name + 1 < len(lms):
        order = [lms[i] for i in suffix_array(reduced, name)]
    else:
        order = [0] * len(lms)
        for i, k in zip(lms, reduced, strict=True):
            order[k] = i
    return induce(order)


def suffix_arrays(s: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The suffix arrays of many strings by induced sorting, one after the other, as places in s; all advance together.

    String m is s[edges[m] : edges[m + 1]] and ends in its only 0. No string is empty. Each has buckets of its own, so in
    one step every string places one suffix. Linear in len(s).
    """
    n, m = len(s), len(edges) - 1
    starts, ends, sizes = edges[:-1], edges[1:] - 1, np.diff(edges)
    tops = np.maximum.reduceat(s, starts).astype(np.int64) + 1
    bucket = (np.repeat(np.cumsum(tops) - tops, sizes) + s).astype(np.int32)
    tails = np.cumsum(np.bincount(bucket, minlength=int(tops.sum()))).astype(np.int32)
    heads = np.concatenate([np.zeros(1, np.int32), tails[:-1]])
    # Types: a suffix is smaller than the next one or larger; of equal characters the next one decides.
    rise = np.ones(n, np.int32)
    rise[:-1] = s[1:] - s[:-1]
    rise[ends] = 1
    small = rise[np.minimum.accumulate(np.where(rise != 0, np.arange(n), n)[::-1])[::-1]] > 0
    before_small = np.zeros(n + 1, bool)
    before_small[1:n] = small[:-1]
    before_large = np.zeros(n + 1, bool)
    before_large[1:n] = ~small[:-1]
    # No suffix stands before a string's first one. Place n, reached as -1, is for room not filled yet.
    before_small[starts] = before_large[starts] = False
    leftmost = small & before_large[:n]
    leftmost[ends] = True
    by_size = np.argsort(-sizes, kind="stable")
    first, longest = starts[by_size], int(sizes.max())
    alive = m - np.searchsorted(np.sort(sizes), np.arange(longest), "right")

    def induce(order: np.ndarray) -> np.ndarray:
        sa = np.full(n, -1, np.int32)
        order = order[np.argsort(bucket[order], kind="stable")]
        of = bucket[order]
        last = np.append(np.flatnonzero(of[1:] != of[:-1]), len(of) - 1)
        sa[tails[of] - np.repeat(last + 1, np.diff(last, prepend=-1)) + np.arange(len(of))] = order
        at = heads.copy()
        for p in range(longest):
            x = sa[first[: alive[p]] + p]
            x = x[before_large[x]] - 1
            c = bucket[x]
            to = at[c]
            sa[to] = x
            at[c] = to + 1
        at = tails.copy()
        for p in range(longest - 1, -1, -1):
            x = sa[first[: alive[p]] + p]
            x = x[before_small[x]] - 1
            c = bucket[x]
            to = at[c] - 1
            sa[to] = x
            at[c] = to
        return sa

    # Sort the leftmost-smaller substrings, name them, and sort their sequences of names by recursion.
    places = np.flatnonzero(leftmost)
    size = np.zeros(n, np.int64)
    size[places] = np.diff(places, append=n) + 1
    size[ends] = 1
    ordered = induce(places)
    ordered = ordered[leftmost[ordered]]
    a, b = ordered[:-1], ordered[1:]
    same = np.concatenate([[False], (size[a] == size[b]) & (s[b] != 0)])
    open_, h = np.flatnonzero(same), 0
    while len(open_):
        x, y = ordered[open_ - 1], ordered[open_]
        equal = s[x + h] == s[y + h]
        same[open_[~equal]] = False
        h += 1
        open_ = open_[equal & (size[y] > h)]
    if not same.any():
        return induce(ordered)
    name = np.cumsum(~same)
    cuts = np.searchsorted(places, edges)
    names = np.empty(n, np.int32)
    # A string's smallest substring is its end, which thus is named 0 again.
    names[ordered] = name - np.repeat(name[cuts[:-1]], np.diff(cuts))
    return induce(places[suffix_arrays(names[places], cuts)])


#: A step that all strings take together costs about as much as this many of them take alone.
TOGETHER = 25


def all_suffix_arrays(s: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """As suffix_arrays; the few longest strings, which would go on alone, are sorted one by one, with the same result."""
    sizes = np.diff(edges)
    longest = np.argsort(sizes, kind="stable")[-TOGETHER:]
    many = np.flatnonzero(sizes <= sizes[longest[0]]) if len(sizes) > TOGETHER else np.zeros(0, np.int64)
    sa = np.empty(len(s), np.int64)
    if len(many):
        cuts = np.concatenate([[0], np.cumsum(sizes[many])])
        at = np.arange(cuts[-1]) + np.repeat(edges[many] - cuts[:-1], sizes[many])
        sa[at] = at[suffix_arrays(s[at], cuts)]
    for k in np.setdiff1d(np.arange(len(sizes)), many).tolist():
        part = s[edges[k] : edges[k + 1]]
        sa[edges[k] : edges[k + 1]] = edges[k] + np.array(suffix_array(part.tolist(), int(part.max())))
    return sa


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, most: int, stop: int) -> np.ndarray:
    """For each place, how many values its suffix shares with the one before it in the array, up to most; none past stop.

    Where the values in front of both are equal, the place before shares one more; only other places are compared.
    """
    s, sa = np.asarray(s), np.asarray(sa)
    n = len(s)
    before, out = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    before[sa[1:]] = sa[:-1]
    follows = (before >= 0) & (s > stop) & (np.roll(s, 1) > stop) & (np.roll(s, 1) == s[np.maximum(before, 0) - 1])
    at, h = np.flatnonzero(~follows & (before >= 0)), 0
    while len(at):
        equal = (s[at + h] == s[before[at] + h]) & (s[at + h] > stop)
        out[at[~equal]] = h
        at, h = at[equal], h + 1
    last = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return np.minimum(out[last] - (np.arange(n) - last), most)


def equal_windows(contexts: list[bytes], anchor: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, group) of all windows, in order; windows of one anchor's contexts share a group if they are equal.

    The contexts of an anchor are side by side and make one string of the shard.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    ends_anchor = np.concatenate([anchor[1:] != anchor[:-1], [True]])
    # Bytes count from 2; 1 ends a context, 0 an anchor's string.
    room = sizes + 1 + ends_anchor
    begin = np.cumsum(room) - room
    s = np.zeros(int(room.sum()), np.int32)
    raw = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int32)
    s[np.arange(len(raw)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)] = raw + 2
    s[begin + sizes] = 1
    edges = np.concatenate([[0], (begin + room)[ends_anchor]])
    sa = all_suffix_arrays(s, edges)
    group = np.empty(len(s), np.int64)
    group[sa] = np.cumsum(permuted_prefixes(s, sa, width, 1)[sa] < width)
    windows = np.maximum(sizes - width + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), windows)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    return owner, start, group[begin[owner] + start]


def anchors(raw: np.ndarray, width: int = WIDTH, k: int = ANCHOR) -> np.ndarray:
    """The places of the k-byte anchors of all windows, ascending.

    The smallest hash of SEED bytes in a window, the first of equal ones, stands at some place p of it; the anchor is at p
    modulo the number of places that an anchor can have. So it depends on the window alone, and anchors are about as rare
    as if single bytes were hashed, though they are long.
    """
    n = len(raw)
    if n < width:
        return np.zeros(0, np.int64)
    x = raw.astype(np.uint64)
    # SEED bytes as one number: two, four, then five.
    h = x[:-1] | x[1:] << np.uint64(8)
    h = h[:-2] | h[2:] << np.uint64(16)
    h = h[:-1] | x[SEED - 1 :] << np.uint64(32)
    # The upper half is the hash, the lower one the place: the smallest number has both.
    h = (_mixed(h) & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    p = (_slide(h, width - SEED + 1, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(p))
    at = start + (p - start) % (width - k + 1)
    found = np.zeros(n, bool)
    found[at] = True
    return np.flatnonzero(found)


def _slide(x: np.ndarray, span: int, best) -> np.ndarray:
    size = 1
    while 2 * size <= span:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (span - size)], x[span - size :]) if span > size else x


def _docs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc: the id, null as the largest number; own: a hash of the text, so that rows of one id stay apart."""
    body = text_or_empty(text)
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("doc"), F.col(doc_id).isNull().alias("none"), F.xxhash64(body).alias("own"), body.alias("text"))


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


#: h, c: hashes of an anchor and its context; place: where the context is in the text of (doc, own), see _place.
_FOUND = "h long, c long, doc long, own long, place long"


def _place(lo: np.ndarray, low_bits: np.ndarray, done) -> np.ndarray:
    """Packs a first byte, 31 bits that say more, and whether the bytes are known to go."""
    return lo << 32 | low_bits << 1 | done


def _anchored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All anchors of each text. A context that a smaller document of the same batch has goes at once: it need not meet
    others, and its bytes leave as ranges of (lo, size) under a number of its text, so that frequent ones are spread."""
    for pdf in batches:
        docs, owns, counts, parts = pdf["doc"].to_numpy(), pdf["own"].to_numpy(), [], []
        for text in pdf["text"]:
            raw = np.frombuffer(_bytes(text), np.uint8)
            at = anchors(raw)
            counts.append(len(at))
            if not len(at):
                continue
            n = len(raw)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((raw + np.uint64(1)) * _power(n)[0], out=sums[1:])
            lo, hi = np.maximum(at - REACH, 0), np.minimum(at + WIDTH, n)
            c = _mixed(span_hashes(raw, lo, hi, sums) + (at - lo).astype(np.uint64))
            parts.append((span_hashes(raw, at, at + ANCHOR, sums), c, lo, hi - lo, at - lo))
        if not parts:
            continue
        h, c, lo, size, front = (np.concatenate(x) for x in zip(*parts, strict=True))
        of = np.repeat(np.arange(len(counts)), counts)
        # Only the smallest document with a context stays in the search.
        order = np.argsort(c)
        cs, hs, doc = c[order], h[order], docs[of[order]]
        begin = np.flatnonzero(np.concatenate([[True], (cs[1:] != cs[:-1]) | (hs[1:] != hs[:-1])]))
        gone = np.zeros(len(order), bool)
        gone[order] = doc > np.repeat(np.minimum.reduceat(doc, begin), np.diff(begin, append=len(order)))
        stay = ~gone
        yield pd.DataFrame({"h": h[stay].view(np.int64), "c": c[stay].view(np.int64), "doc": docs[of[stay]], "own": owns[of[stay]], "place": _place(lo[stay], front[stay] << 8 | size[stay], 0)})
        if gone.any():
            text, a, b = _ranges(of[gone], lo[gone], lo[gone] + size[gone])
            spread = _mixed((docs[text] + owns[text]).view(np.uint64)).view(np.int64)
            yield pd.DataFrame({"h": spread, "c": 0, "doc": docs[text], "own": owns[text], "place": _place(a, b - a, 1)})


def _ranges(of: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of, lo, hi) of the ranges that overlapping or touching ones make, for ranges ascending by of, then lo and hi."""
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (lo[1:] > hi[:-1])
    begin = np.flatnonzero(new)
    return of[begin], lo[begin], hi[np.append(begin[1:], len(of))[: len(begin)] - 1]


#: What becomes of a place: all of it goes, it is searched, or it gets what is found at the first place of its context.
DONE, FIRST, FURTHER = 0, 1, 2
_STATES = f"{_FOUND}, state int"


def _repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (h, c, doc): DONE for contexts that a smaller document has; FIRST for the first of each context of
    an anchor that has several; FURTHER for others in the first one's document. One row of the open anchor is held."""
    names = [x.split()[0] for x in _FOUND.split(", ")]
    held, last_h, last_c, first_doc, several = None, None, None, 0, False
    for pdf in batches:
        if not len(pdf):
            continue
        gone = (pdf["place"].to_numpy() & 1) == 1
        if gone.any():
            yield pdf.loc[gone, names].assign(state=DONE)
            pdf = pdf[~gone]
            if not len(pdf):
                continue
        h, c, doc = (pdf[x].to_numpy() for x in ("h", "c", "doc"))
        new = np.ones(len(pdf), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        new[0] = (h[0] != last_h) or (c[0] != last_c)
        firsts = np.maximum.accumulate(np.where(new, np.arange(len(pdf)), -1))
        least = np.where(firsts >= 0, doc[np.maximum(firsts, 0)], first_doc)
        starts = np.flatnonzero(new)
        hs = h[starts]
        many = np.zeros(len(starts), bool)
        many[1:] |= hs[1:] == hs[:-1]
        many[:-1] |= hs[1:] == hs[:-1]
        if len(starts) and hs[0] == last_h:
            # The open anchor goes on: its first context is one of several, too.
            many[hs == last_h] = True
            if not several:
                yield held.assign(state=FIRST)
            several = True
        # The last context of the batch is held while it is its anchor's only one.
        if len(starts) and hs[-1] != last_h:
            several = bool(many[-1])
            held = pdf.iloc[starts[-1:]][names]
        last_h, last_c, first_doc = h[-1], c[-1], least[-1]
        yield pd.concat([pdf.loc[doc > least, names].assign(state=DONE), pdf.iloc[starts[many]][names].assign(state=FIRST), pdf.loc[(doc == least) & ~new, names].assign(state=FURTHER)])


_CONTEXT = "h long, c long, doc long, own long, place long, context binary"


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _CONTEXT.split(", ")]
    for pdf in batches:
        rows = []
        for doc, own, text, *places in zip(pdf["doc"], pdf["own"], pdf["text"], pdf["h"], pdf["c"], pdf["place"], strict=True):
            raw = _bytes(text)
            for h, c, p in zip(*(x.tolist() for x in places), strict=True):
                lo = p >> 32
                rows.append((h, c, doc, own, p, raw[lo : lo + (p >> 1 & 0xFF)]))
        yield pd.DataFrame(rows, columns=names)


def _sharded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by h: shards of whole anchors; the windows of each context that a smaller document has."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        h = pdf["h"].to_numpy()
        # The last anchor may go on in the next batch; all before it are whole.
        cut = int(np.searchsorted(h, h[-1]))
        if held and (cut or h[0] != held[0]["h"].iloc[0]):
            yield from _windows(pd.concat([*held, pdf.iloc[:cut]]))
            held = []
        elif cut:
            yield from _windows(pdf.iloc[:cut])
        held.append(pdf.iloc[cut:])
    if held:
        yield from _windows(pd.concat(held))


def _windows(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    h = rows["h"].to_numpy()
    edges = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1, [len(h)]])
    sizes = np.concatenate([[0], np.cumsum(rows["context"].map(len).to_numpy())])
    start = 0
    for end in edges[1:]:
        if sizes[end] - sizes[start] >= SHARD or end == len(h):
            yield _shard(rows.iloc[start:end])
            start = end


def _may_share(h: np.ndarray, contexts: list[bytes], front: np.ndarray) -> np.ndarray:
    """Which contexts may have a window in common with another one of their anchor.

    A window has half of REACH in front of its anchor, or the rest of it behind. Contexts that share neither such bytes
    with any other can be left out of the search.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    half = REACH // 2
    out = np.zeros(len(h), bool)
    for first, n in ((front - half, half), (front + ANCHOR, REACH - half)):
        has = np.flatnonzero((first >= 0) & (first + n <= sizes))
        key = h[has].astype(np.uint64)
        for j in range(n):
            key = (key + raw[begin[has] + first[has] + j]) * np.uint64(0x9E3779B97F4A7C15)
        key = _mixed(key)
        _, of, times = np.unique(key, return_inverse=True, return_counts=True)
        out[has] |= times[of] > 1
    return out


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    place = rows["place"].to_numpy()
    rows = rows[_may_share(rows["h"].to_numpy(), rows["context"].tolist(), place >> 9 & 0xFF)]
    if not len(rows):
        return pd.DataFrame(columns=_WINDOWS)
    owner, start, group = equal_windows(rows["context"].tolist(), rows["h"].to_numpy())
    doc, first = rows["doc"].to_numpy(), rows["place"].to_numpy() >> 32
    least = np.full(int(group.max()) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc[owner])
    hit = np.flatnonzero(least[group] < doc[owner])
    who, a, b = _ranges(owner[hit], start[hit], start[hit] + WIDTH)
    out = rows[["h", "c", "doc", "own"]].iloc[who]
    return out.assign(first=first[who], lo=first[who] + a, hi=first[who] + b)[_WINDOWS]


#: Ranges of a context that go; first is where the context begins.
_WINDOWS = ["h", "c", "doc", "own", "first", "lo", "hi"]


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _rewritten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, none, text, lo, hi in zip(pdf["doc"].tolist(), pdf["none"].tolist(), pdf["text"].tolist(), pdf["lo"], pdf["hi"], strict=True):
            raw = np.frombuffer(_bytes(text), np.uint8)
            change = np.zeros(len(raw) + 1, np.int32)
            if lo is not None:
                np.add.at(change, lo, 1)
                np.add.at(change, hi, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = raw[~gone].tobytes()
            spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
            rows.append((None if none else doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in REMOVED.split(", ")])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): the bytes that are left of each text.

    A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller id (a long). Strings are
    judged on the input; matches never cross documents, and all places of a string in a document go alike. Null and empty texts have no bytes, texts under 50 bytes lose
    none. Null ids come after all others and are equal to each other. Rows that share an id don't count against each
    other. Repeated rows repeat their result. An empty table gives an empty one. Other columns are left out, whatever
    their names.
    """
    each, n = _docs(docs, doc_id, text), n_parts(docs.sparkSession)
    found = each.mapInPandas(_anchored, _FOUND)
    places = stored(found.repartition(n, "h").sortWithinPartitions("h", "c", "doc").mapInPandas(_repeated, _STATES), "places")
    key = ["doc", "own"]
    lists = [F.collect_list(x).alias(x) for x in ("h", "c", "place")]
    ask = places.where(F.col("state") == FIRST).groupBy(*key).agg(*lists)
    contexts = each.dropDuplicates(key).join(ask, key).mapInPandas(_contexts, _CONTEXT)
    windows = contexts.repartition(n, "h").sortWithinPartitions("h").mapInPandas(_sharded, ", ".join(f"{x} long" for x in _WINDOWS))
    windows = stored(windows, "windows")
    lo = F.shiftright("place", 32)
    offsets = windows.select("h", "c", (F.col("lo") - F.col("first")).alias("a"), (F.col("hi") - F.col("first")).alias("b"))
    carried = places.where(F.col("state") == FURTHER).join(offsets, ["h", "c"]).select(*key, (lo + F.col("a")).alias("lo"), (lo + F.col("b")).alias("hi"))
    # The size of a context takes eight bits; that of a range of whole contexts all that are left.
    size = F.when(F.col("place").bitwiseAND(F.lit(1)) == 1, F.shiftright("place", 1).bitwiseAND(F.lit(0x7FFFFFFF))).otherwise(F.shiftright("place", 1).bitwiseAND(F.lit(0xFF)))
    done = places.where(F.col("state") == DONE).select(*key, lo.alias("lo"), (lo + size).alias("hi"))
    gone = done.unionByName(windows.select(*key, "lo", "hi")).unionByName(carried)
    ranges = gone.groupBy(*key).agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    return each.join(ranges, key, "left").select("doc", "none", "text", "lo", "hi").mapInPandas(_rewritten, REMOVED)
