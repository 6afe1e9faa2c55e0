"""Near-duplicate classes by Order MinHash and MinHash, verified by banded alignment.

A document's shingles (five words) are labelled with their occurrence, so repeats count. For each of many hash functions
the two smallest are kept in the order in which the text has them. Two such samples make a bucket key: documents meet if
the same shingles are smallest in both and stand in the same order, which follows edit similarity more than set overlap.
Further buckets and a sketch are taken from the set of shingles, by which links are defined: they bound what is missed.
Equal texts are one node throughout. Candidate pairs are verified on the words; classes are connected components.

A bucket is worked off in rounds, each with more of its nodes as centres than the one before. After a round the nodes that
came together count as one, and finer sketches rule out most of what is left, so that a large group of near copies takes
about as many pairs as it has nodes. In the last round every node has been a centre: no link is left out.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored, text_or_empty
from .fingerprints import _power, span_hashes

WORDS = 5
LEAST = 0.8
#: Ordered buckets a document, hash functions a bucket, and smallest shingles a function.
BANDS, SAMPLES, SMALLEST = 24, 2, 2
#: Marks of a sketch, four bits each; the chance that a pair at the bound shares no set bucket, and that its sketches
#: differ in too many marks.
SKETCH, MISSED = 128, 5e-6
#: Marks of the finer sketch, a bit each, that texts get whose buckets are not done after the first round.
FINER = 1024
#: A round takes this many times the centres of the one before.
MORE_CENTRES = 32
#: A bucket of this many rows stands against its centres in one cell of the join. Larger ones are salted into as many cells
#: as the root of their size in such units, so that neither a cell nor the copies of the centres grow as fast as the bucket squared.
BUCKET_ROWS = 200
#: Bytes of words that a worker keeps for the texts it has met.
KEPT_BYTES = 32_000_000

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@functools.cache
def _seeds(n: int) -> np.ndarray:
    return _mixed(np.arange(1, 1 + n, dtype=np.uint64) * _GOLD) | np.uint64(1)


@functools.cache
def bounds(least: float) -> tuple[int, int, int]:
    """(set buckets, hash functions a bucket, marks in which sketches may differ), for pairs that share least of their set.

    Such a pair agrees in a function with a chance of least, and differs in a mark of four bits with one of
    (1 - least) * 15 / 16. At 0.8 it gives 24 buckets of 4 functions, and 44 marks.
    """
    if not 0 < least <= 1:
        raise ValueError(f"least is {least}, not above 0 and up to 1")
    rows = next(r for r in (4, 3, 2, 1) if least**r >= 0.25 or r == 1)
    bands = 1 if least == 1 else math.ceil(math.log(MISSED) / math.log1p(-(least**rows)))
    return bands, rows, most_apart(least, SKETCH, 4)


@functools.cache
def most_apart(least: float, marks: int, bits: int) -> int:
    """In how many marks of so many bits sketches of a pair at least may differ, but for a chance of MISSED."""
    p, over, most = (1 - least) * (1 - 0.5**bits), 0.0, marks
    while over <= MISSED and most >= 0:
        over += math.comb(marks, most) * p**most * (1 - p) ** (marks - most)
        most -= 1
    return most + 1


#: The columns of the two sketches.
LONGS, FINER_LONGS = [f"s{i}" for i in range(SKETCH // 16)], [f"f{i}" for i in range(FINER // 64)]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit number for each word, lower-cased."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    part = (raw != 32) & (raw - np.uint8(9) > 4)
    change = np.flatnonzero(part[1:] != part[:-1]) + 1
    edges = np.concatenate([[0] if part[0] else [], change, [len(raw)] if part[-1] else []]).astype(np.int64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * _power(len(raw))[0], out=sums[1:])
    return span_hashes(raw, edges[::2], edges[1::2], sums)


def shingles(words: np.ndarray, width: int = WORDS) -> np.ndarray:
    """A hash of each run of width words; of all words, if there are fewer."""
    n = len(words)
    k = min(width, n)
    if not k:
        return np.zeros(0, np.uint64)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = (out + words[i : n - k + 1 + i]) * _GOLD
    return _mixed(out)


def labelled(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, each mixed with how often it came before, and whether it never did."""
    ordered = np.sort(hashes)
    begin = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if begin.all():
        return _mixed(hashes), np.ones(len(hashes), bool)
    order = np.argsort(hashes, kind="stable")
    place = np.arange(len(hashes))
    times = np.empty(len(hashes), np.uint64)
    times[order] = place - np.maximum.accumulate(np.where(begin, place, 0))
    return _mixed(hashes + times * _GOLD), times == 0


def _smallest(marks: np.ndarray, functions: int, pairs: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The places of the smallest mark of each function, and of the second one of the first so many functions."""
    n, every = len(marks), _seeds(skip + functions)[skip:]
    firsts, seconds = np.empty(functions, np.int64), np.zeros(pairs, np.int64)
    at_once = max(1, (1 << 16) // n)
    for f in range(0, functions, at_once):
        seeds = every[f : f + at_once, None]
        ranks = (marks[None, :] ^ (seeds >> np.uint64(7))) * seeds
        firsts[f : f + at_once] = low = ranks.argmin(1)
        for_keys = max(0, min(len(low), pairs - f))
        if for_keys:
            ranks[np.arange(for_keys), low[:for_keys]] = np.uint64(0xFFFFFFFFFFFFFFFF)
            seconds[f : f + for_keys] = ranks[:for_keys].argmin(1)
    return firsts, seconds


def order_sketch(marks: np.ndarray, distinct: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(a key for each ordered and each set bucket, the sketch as longs) of labelled shingles.

    distinct tells the marks that stand for the set of shingles. Set buckets and sketch come from these only.
    """
    bands, rows, _ = bounds(least)
    functions, of_set = BANDS * SAMPLES, max(SKETCH, bands * rows)
    if distinct.all():
        # Without repeats the marks are the set.
        lows, seconds = _smallest(marks, max(functions, of_set), functions)
        firsts, low_marks = lows[:functions], marks[lows[:of_set]]
    else:
        firsts, seconds = _smallest(marks, functions, functions)
        once = marks[distinct]
        low_marks = once[_smallest(once, of_set, 0)[0]]
    # The two smallest of each function in the order of the text, mixed into the key of its bucket one after the other.
    pairs = np.sort(np.stack([firsts, seconds if len(marks) > 1 else firsts], 1), axis=1).reshape(BANDS, SAMPLES * SMALLEST)
    keys = np.arange(BANDS, dtype=np.uint64) * _M1
    for c in range(SAMPLES * SMALLEST):
        keys = _mixed((keys + marks[pairs[:, c]]) * _GOLD)
    set_keys = np.arange(BANDS, BANDS + bands, dtype=np.uint64) * _M1
    for c in range(rows):
        set_keys = _mixed((set_keys + low_marks[c : bands * rows : rows]) * _GOLD)
    four = (_mixed(low_marks[:SKETCH] * _seeds(SKETCH)) & np.uint64(15)).astype(np.uint8)
    return np.concatenate([keys, set_keys]).view(np.int64), (four[::2] << np.uint8(4) | four[1::2]).view(np.int64)


def finer_sketches(texts: DataFrame) -> DataFrame:
    """(node, sketch of FINER marks) of the texts (node, text); its functions are none of the first sketch's."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                marks, distinct = labelled(shingles(word_hashes(text)))
                once = marks[distinct]
                bits = _mixed(once[_smallest(once, FINER, 0, SKETCH)[0]] * _seeds(FINER)) & np.uint64(1)
                rows.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
            if rows:
                yield pd.DataFrame(np.stack(rows), columns=FINER_LONGS).assign(node=pdf["node"].to_numpy())

    return texts.select("node", "text").mapInPandas(each, f"{', '.join(f'{c} long' for c in FINER_LONGS)}, node long")


_SKETCHED = f"keys array<long>, n long, {', '.join(f'{c} long' for c in LONGS)}"
SKETCHES = f"rid long, doc_id {{id}}, md5 string, {_SKETCHED}"


def sketched(docs: DataFrame, doc_id: str, text: str, least: float = LEAST) -> DataFrame:
    """A row of SKETCHES for each document: n counts its set of shingles; texts without words have no keys."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    names = [c.split()[0] for c in _SKETCHED.split(", ")]

    @F.pandas_udf(_SKETCHED)
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, np.int64)
        for texts in batches:
            out = []
            for t in texts:
                marks, distinct = labelled(shingles(word_hashes(t)))
                keys, longs = order_sketch(marks, distinct, least) if len(marks) else (none, np.zeros(SKETCH // 16, np.int64))
                out.append((keys, int(distinct.sum()), *longs.tolist()))
            yield pd.DataFrame(out, columns=names)

    return rows.withColumns({"md5": F.md5("text"), "sketch": sketch("text")}).select("rid", "doc_id", "md5", "sketch.*")


def _edit_distance(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Insertions, deletions and changes from a to b, within a band of diagonals; band + 1 if it takes more."""
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return band + 1
    if not n or not m:
        return n + m
    far = band + 1
    offsets = np.arange(-band, band + 1)
    row = np.where((offsets >= 0) & (offsets <= m), offsets, far)
    for i in range(1, n + 1):
        j = i + offsets
        inside = (j >= 1) & (j <= m)
        same = np.zeros(len(j), bool)
        same[inside] = b[j[inside] - 1] == a[i - 1]
        new = np.minimum(np.where(inside, row + ~same, far), np.concatenate([row[1:], [far]]) + 1)
        new = np.where(j == 0, i, new)
        new = np.where((j < 0) | (j > m), far, new)
        # Insertions run along the row.
        row = np.minimum(np.minimum.accumulate(new - offsets) + offsets, far)
        row = np.where((j < 0) | (j > m), far, row)
    return int(min(row[m - n + band], far))


def _within(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance of two runs of words; most + 1 if it is more. The band widens until it holds the path."""
    for _ in range(2):
        # What both have in front costs nothing, nor what both have at the end.
        k = min(len(a), len(b))
        other = np.flatnonzero(a[:k] != b[:k])
        n = int(other[0]) if len(other) else k
        a, b = a[n:][::-1], b[n:][::-1]
    k = min(len(a), len(b))
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if k <= 1:
        return min(most + 1, max(n, m) - int(k == 1 and bool((a[:, None] == b[None, :]).any())))
    band = min(most, abs(n - m) + 8)
    while True:
        cost = _edit_distance(a, b, band)
        if cost <= band or band >= most:
            return min(cost, most + 1)
        band = min(most, 4 * band)


def edit_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """1 - distance / longer length of two word sequences; 0 if below least.

    Shingles that either side has once are anchors; where they chain in one order, only the gaps between them are
    aligned. If that path is too costly, the whole is aligned within the band that least leaves.
    """
    return _edit_similarity(Words(a), Words(b), least)


class Words:
    """A text's words as numbers, its shingles in order, and its set of shingles with the place of each found once."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.distinct, at, counts = np.unique(shingles(words), return_index=True, return_counts=True)
        self.once, self.at = self.distinct[counts == 1], at[counts == 1]
        self.bytes = 8 * (len(words) + len(self.distinct) + 2 * len(self.once))


def _edit_similarity(a: Words, b: Words, least: float) -> float:
    longest = max(len(a.words), len(b.words))
    if not longest:
        return 1.0
    band = int((1 - least) * longest + 1e-9)
    cost = _chained_cost(a, b, band)
    if cost > band:
        cost = _within(a.words, b.words, band)
    return 1 - cost / longest if cost <= band else 0.0


def _chained_cost(a: Words, b: Words, most: int) -> int:
    """The cost of the path through the anchors, or something over most; no less than the edit distance."""
    _, xa, xb = np.intersect1d(a.once, b.once, assume_unique=True, return_indices=True)
    i, j = a.at[xa], b.at[xb]
    order = np.argsort(i)
    i, j = i[order], j[order]
    # Anchors out of order are passed over: what follows must lie beyond all before.
    keep = j > np.concatenate([[-1], np.maximum.accumulate(j)[:-1]]) if len(j) else np.zeros(0, bool)
    i, j = np.concatenate([[0], i[keep], [len(a.words)]]), np.concatenate([[0], j[keep], [len(b.words)]])
    # Anchors that follow one another within a shingle's length on one diagonal have equal words between them.
    width = min(WORDS, len(a.words), len(b.words))
    di, dj = np.diff(i), np.diff(j)
    cost, inner = 0, np.arange(len(di)) > 0
    for g in np.flatnonzero((di != dj) | (di > width) | ~inner).tolist():
        cost += _within(a.words[i[g] : i[g + 1]], b.words[j[g] : j[g + 1]], most - cost)
        if cost > most:
            break
    return cost


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether two word sequences share least of their shingles, as sets, and are that close when aligned."""
    return _similar(Words(a), Words(b), least)


def _similar(a: Words, b: Words, least: float) -> bool:
    few, many = sorted((len(a.distinct), len(b.distinct)))
    if few < least * many:
        return False
    both = len(np.intersect1d(a.distinct, b.distinct, assume_unique=True))
    return both >= least * (few + many - both) and _edit_similarity(a, b, least) >= least


def _anchored_cost(a: np.ndarray, b: np.ndarray, most: int) -> int:
    return _chained_cost(Words(a), Words(b), most)


class Met(dict):
    """The words of the nodes that a worker has met; forgets all when they take too much room."""

    def __init__(self):
        super().__init__()
        self.bytes = 0

    def words(self, node: int, text: str) -> Words:
        found = self.get(node)
        if found is None:
            found = Words(word_hashes(text))
            if self.bytes > KEPT_BYTES:
                self.clear()
                self.bytes = 0
            self[node] = found
            self.bytes += found.bytes
        return found


def _close(least: float, finer: bool) -> Column:
    """Whether the sketches of x and y differ in no more marks than those of a link may."""
    apart = [F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")) for c in (FINER_LONGS if finer else LONGS)]
    if not finer:
        # The lowest bit of each four tells whether any of them differs.
        apart = [x.bitwiseOR(F.shiftrightunsigned(x, 1)) for x in apart]
        apart = [x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)) for x in apart]
    return sum(map(F.bit_count, apart), F.lit(0)) <= (most_apart(least, FINER, 1) if finer else most_apart(least, SKETCH, 4))


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = Met()
        for pdf in batches:
            rows = zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["ta"], pdf["tb"], strict=True)
            yes = [_similar(met.words(a, x), met.words(b, y), least) for a, b, x, y in rows]
            yield pdf.loc[yes, ["a", "b"]]

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb").mapInPandas(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes with links (a, b), by alternating stars.

    Rounds go on until nothing changes; there are about as many as the logarithm of the longest chain of links.
    """
    stars = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    before = None
    while True:
        # Large star: each node's larger neighbours turn to its smallest; small star: so do it and its smaller ones.
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        stars = stored(small, "links")
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == before:
            return stars.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
        before = state


def _met(nodes: DataFrame) -> DataFrame:
    """(key, node, size, level): the buckets that several nodes share, and the round in which each is a centre.

    The first centre is the node that meets most others in all its buckets: the middle of a group of near copies. Later
    ones are drawn by hash, MORE_CENTRES times as many each round.
    """
    rows = nodes.select(F.explode("keys").alias("key"), "node")
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(rows.join(sizes, "key"), "shared")
    meets = shared.groupBy("node").agg(F.sum("size").alias("meets"))
    first = shared.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", (-F.col("node")).alias("node"))).alias("x"))
    share = F.pmod(F.xxhash64("key", "node"), F.lit(1 << 40)) / float(1 << 40)
    drawn = F.greatest(F.lit(1), F.ceil(F.log(F.greatest(share * F.col("size"), F.lit(1e-9))) / math.log(MORE_CENTRES)))
    level = F.when(F.col("node") == -F.col("x.node"), 0).otherwise(drawn).cast("int")
    return stored(shared.join(first, "key").select("key", "node", "size", level.alias("level")), "met")


def _of_round(left: DataFrame, facts: DataFrame, at: int, least: float) -> DataFrame:
    """(a, b): the centres of a round with the other nodes of their buckets that may be linked to them, each pair once.

    left: the nodes of this round and later ones in buckets that are not done; facts (node, root, n, places, sketch): what is
    known of each, places being its buckets with its rounds in them.
    """
    parts = F.ceil(F.sqrt(F.col("size") / BUCKET_ROWS))
    keys = lambda some: F.transform(some, lambda p: p["key"])
    early, central = F.filter("places", lambda p: p["level"] < at), F.filter("places", lambda p: p["level"] == at)
    known = left.join(facts.withColumns({"keys": keys("places"), "early": keys(early), "central": keys(central)}).drop("places"), "node")
    centres = known.where(F.col("level") == at).withColumn("salt", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)))
    others = known.withColumn("salt", F.pmod(F.xxhash64("node"), parts).cast("int"))
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.node") != F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    fit = (F.least("x.n", "y.n") >= least * F.greatest("x.n", "y.n")) & _close(least, at > 0)
    # Of the buckets in which a centre meets a node one gives the pair; of two centres the smaller; and no earlier round did.
    # A bucket that is done does not count: its nodes of this round and later ones have one root.
    first = F.array_min(F.array_intersect("x.central", "y.keys")) == F.col("x.key")
    # exists, unlike arrays_overlap, keeps the condition out of the join's one generated method, which would be too long to be compiled.
    meets = lambda some, keys: F.exists(some, lambda k: F.array_contains(keys, k))
    mine = (F.col("x.node") < F.col("y.node")) | ~meets("y.central", F.col("x.keys"))
    new = ~meets("x.early", F.col("y.keys")) & ~meets("y.early", F.col("x.keys"))
    pairs = centres.alias("x").join(others.alias("y"), meet & fit & first & mine & new)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def linked(nodes: DataFrame, texts_of, least: float = LEAST) -> DataFrame:
    """(node, root) of the nodes that have links. nodes: (node, keys, n, sketch); texts_of(nodes) gives (node, text)."""
    left, at, roots = _met(nodes), 0, None
    places = left.groupBy("node").agg(F.collect_list(F.struct("key", "level")).alias("places"))
    facts = stored(nodes.select("node", "n", *LONGS).join(places, "node"), "facts")
    texts = stored(texts_of(facts.select("node")), "texts")
    while left is not None:
        if at == 1:
            finer = finer_sketches(texts.join(left.select("node").distinct(), "node", "left_semi"))
            facts = stored(facts.select("node", "n", "places").join(finer, "node"), "finer")
        placed = facts.withColumn("root", F.col("node")) if roots is None else facts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        pairs = stored(_of_round(left, placed, at, least), "pairs")
        before, roots = roots, _united(roots, _verified(pairs, texts, least))
        roots = roots if roots is before else stored(roots, "roots")
        left, at = _still_open(left, roots, at), at + 1
    return roots


def _united(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after further links; only the roots they join are walked again."""
    if roots is None:
        return components(links)
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    joined = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joined = stored(joined.where("a <> b"), "joined")
    if joined.isEmpty():
        return roots
    moved = components(joined)
    new = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    # Roots have no rows of their own, so what moved is not in there yet.
    return new.unionByName(moved)


def _still_open(left: DataFrame, roots: DataFrame, at: int) -> DataFrame | None:
    """The nodes of later rounds in buckets where these are not one component yet; None if there are none."""
    rest = left.where(F.col("level") > at)
    placed = rest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    out = stored(rest.join(several, "key"), "open")
    return None if out.isEmpty() else out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, md5, class_id, rid, keeper): the class of each document, and whether it is the one that stays of its class.

    Two texts are linked if they share at least ``least`` of their five-word shingles, as sets of lower-cased words, and
    their aligned words are as similar. So copies with moved parts (halves swapped, a long paragraph elsewhere) are not
    linked, though they share nearly all shingles. Equal texts are linked. class_id is the smallest id in a class (null if all are);
    the keeper is a row with that id. A pair that is to be linked is missed with a chance below 0.00001, repeats or not.

    Null and empty texts are equal to each other, and blank ones are linked to equal ones only, as are texts of fewer
    than five words. Repeated rows are equal texts, and one of them is kept. Rows that share an id but not a text may be
    in different classes. An empty table gives an empty one. Other columns are left out, whatever their names.
    """
    table = stored(sketched(docs, doc_id, text, least), "sketches")
    # One node for each distinct text: the smallest row number.
    ids = table.groupBy("md5").agg(F.min("rid").alias("node"))
    nodes = stored(table.withColumnRenamed("rid", "node").join(ids.select("node"), "node", "left_semi").select("md5", "node", "keys", "n", *LONGS), "nodes")
    roots = linked(nodes, lambda asked: _texts(docs, text, nodes, asked), least)
    of = nodes.select("md5", "node").join(roots, "node", "left").select("md5", F.coalesce("root", "node").alias("root"))
    members = table.select("rid", "doc_id", "md5").join(of, "md5")
    best = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("k"))
    return members.join(best, "root").select("doc_id", "md5", F.col("k.doc_id").alias("class_id"), "rid", (F.col("rid") == F.col("k.rid")).alias("keeper"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """docs without all but one document of each class of near_duplicates, whose definitions hold."""
    fresh(docs, "_key")
    key = lambda i, m: F.concat_ws(":", m, i.cast("string"))
    kept = near_duplicates(docs, doc_id, text, least).where("keeper").select(key(F.col("doc_id"), F.col("md5")).alias("_key"))
    found = docs.withColumn("_key", key(F.col(doc_id), F.md5(text_or_empty(text)))).join(kept, "_key", "left_semi")
    # Repeats of one row share a key.
    return found.dropDuplicates(["_key"]).drop("_key")


def _texts(docs: DataFrame, text: str, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, text) of the nodes asked for; equal texts are brought together before they move."""
    body = text_or_empty(text)
    distinct = docs.select(F.md5(body).alias("md5"), body.alias("text")).groupBy("md5").agg(F.min("text").alias("text"))
    return distinct.join(nodes.select("md5", "node").join(asked, "node"), "md5").select("node", "text")
