"""SentencePiece encoding by unigram Viterbi over a double-array trie of pieces, with byte fallback; and decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import fresh, text_or_empty

#: Stands for a space at the front of a word.
MARKER = "▁"
_MARK = MARKER.encode()
#: What an unknown character costs beyond the worst piece; fixed by the encoding.
UNKNOWN_PENALTY = 10.0
#: Bytes of chunks and their pieces that a worker remembers, with what Python adds to each.
REMEMBERED, PER_CHUNK = 24_000_000, 160
#: Bytes of chunks that are searched together, and of texts that are encoded together.
TOGETHER, BATCH = 150_000, 1_000_000
_CHUNK = re.compile(r" +[^ ]*")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass
class Vocabulary:
    """pieces and their log scores by id; usable: whether a piece may match text (not control, unknown or byte pieces)."""

    pieces: list[str]
    scores: list[float]
    usable: list[bool]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        return cls([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], [not special(i) for i in ids])


class Trie:
    """A double-array trie over bytes: from state s byte c leads to base[s] + c + 1 if check there is s. value: id or -1."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in keys.items():
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    values.append(-1)
                node = children[node][c]
            values[node] = value
        # States with several children take room at the end, side by side; those with one child fill the holes.
        spans = sum(max(c) - min(c) + 1 for c in children if len(c) > 1)
        size = spans + len(children) + 1024
        taken, free, top, todo = bytearray(size), 257, 257, [(0, 0)]
        base, check, value = [0] * size, [-1] * size, [-1] * size
        taken[0], value[0] = 1, values[0]
        while todo:
            node, at = todo.pop()
            if not (below := children[node]):
                continue
            low = min(below) + 1
            while taken[free]:
                free += 1
            begin = max(0, free - low) if len(below) == 1 else max(0, top - low)
            while any(taken[begin + c + 1] for c in below):
                begin += 1
            base[at] = begin
            for c, child in below.items():
                to = begin + c + 1
                taken[to], check[to], value[to] = 1, at, values[child]
                todo.append((child, to))
            top = max(top, begin + max(below) + 2)
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))
        pad = np.full(512, -1, np.int32)
        self.base, self.check, self.value = np.concatenate([self.base, pad * 0]), np.concatenate([self.check, pad]), np.concatenate([self.value, pad])

    def matches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of every key found at one of the starts, not beyond its end; all starts advance together."""
        found, state, at, begin = [], np.zeros(len(starts), np.int64), starts.copy(), starts
        while len(at):
            live = at < ends
            state, at, begin, ends = state[live], at[live], begin[live], ends[live]
            to = self.base[state].astype(np.int64) + data[at] + 1
            ok = self.check[to] == state
            state, at, begin, ends = to[ok], at[ok] + 1, begin[ok], ends[ok]
            hit = self.value[state] >= 0
            found.append((begin[hit], at[hit], self.value[state[hit]].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


class Encoder:
    """Encodes texts with a vocabulary; chunks met before are remembered, up to a bound.

    A space becomes the marker, and one stands before the text. No piece has a marker behind another character (checked),
    so the best path of a text is that of its chunks: markers, then what follows up to the next marker. A marker that is
    in the text itself goes to bytes, so that decoding gives it back.
    """

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        if any(MARKER in p.lstrip(MARKER) for p, ok in zip(v.pieces, v.usable, strict=True) if ok):
            raise ValueError("a piece has a marker behind another character; its texts can't be cut into chunks")
        self.scores = np.array([*v.scores, min(v.scores) - UNKNOWN_PENALTY])
        self.unknown = len(v.pieces)
        self.bytes = {int(m[1], 16): i for i, p in enumerate(v.pieces) if (m := _BYTE.fullmatch(p))}
        if len(self.bytes) < 256:
            raise ValueError("the vocabulary lacks pieces for single bytes")
        self.byte_ids = np.array([self.bytes[b] for b in range(256)])
        self.trie = Trie({p.encode(): i for i, (p, ok) in enumerate(zip(v.pieces, v.usable, strict=True)) if ok and p})
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.held = 0

    def best(self, chunks: list[bytes]) -> list[bytes]:
        """The ids, four bytes each, on the best path of each chunk of UTF-8 bytes; of equal paths the one with the longer piece last."""
        sizes = np.array([len(c) for c in chunks], np.int64)
        edge = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(chunks), np.uint8).astype(np.int64)
        of = np.repeat(np.arange(len(chunks)), sizes)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        stops = np.concatenate([starts[1:], [len(data)]])
        begin, end, ids = self.trie.matches(data, starts, edge[of[starts] + 1])
        # A character without a piece of its own may be unknown.
        width = np.zeros(len(data) + 1, np.int64)
        width[starts] = stops - starts
        covered = np.zeros(len(data) + 1, bool)
        covered[begin[end - begin == width[begin]]] = True
        bare = ~covered[starts]
        begin, end = np.concatenate([begin, starts[bare]]), np.concatenate([end, stops[bare]])
        ids = np.concatenate([ids, np.full(bare.sum(), self.unknown)])
        # Positions of a chunk share its numbers plus one, so that an end is never the next chunk's start.
        shift = of[begin]
        source, target, offset = begin + shift, end + shift, begin - edge[shift]
        order = np.argsort(offset, kind="stable")
        source, target, ids, offset = source[order], target[order], ids[order], offset[order]
        best = np.full(len(data) + len(chunks), -np.inf)
        last, came = np.full(len(best), -1, np.int64), np.full(len(best), -1, np.int64)
        first = edge[:-1] + np.arange(len(chunks))
        best[first] = 0.0
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(offset)) + 1, [len(offset)]]) if len(offset) else [0, 0]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            s, t, k = source[i:j], target[i:j], ids[i:j]
            score = best[s] + self.scores[k]
            up = score > best[t]
            best[t[up]], last[t[up]], came[t[up]] = score[up], k[up], s[up]
        return self._paths(chunks, data.astype(np.uint8), edge, first, last, came)

    def _paths(self, chunks, data, edge, first, last, came) -> list[bytes]:
        at, live, steps = edge[1:] + np.arange(len(chunks)), np.arange(len(chunks)), []
        while True:
            on = at > first[live]
            live, at = live[on], at[on]
            if not len(live):
                break
            steps.append((live, last[at], came[at] - live, at - live))
            at = came[at]
        if not steps:
            return [b""] * len(chunks)
        who, ids, lo, hi = (np.concatenate(x) for x in zip(*reversed(steps), strict=True))
        order = np.argsort(who, kind="stable")
        who, ids, lo, hi = who[order], ids[order], lo[order], hi[order]
        # An unknown character becomes the pieces of its bytes, the stand-in for a marker those of the marker.
        bare = ids == self.unknown
        raw = [_MARK if data[x] == 0xFF else data[x:y].tobytes() for x, y in zip(lo[bare].tolist(), hi[bare].tolist(), strict=True)]
        times = np.ones(len(ids), np.int64)
        times[bare] = [len(x) for x in raw]
        flat = np.repeat(ids, times)
        flat[np.repeat(bare, times)] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.cumsum(np.bincount(who, weights=times, minlength=len(chunks)).astype(np.int64)) * 4
        packed, cuts = flat.astype(np.int32).tobytes(), [0, *ends.tolist()]
        return [packed[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text. An empty text has none."""
        return [ids.tolist() for ids in self.arrays(texts)]

    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        """As encode, in int32 arrays."""
        cut = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        if self.held > REMEMBERED:
            self.forget()
        new = list(dict.fromkeys(c for chunks in cut for c in chunks if c not in self.known))
        # 0xFF is in no UTF-8 text and no piece.
        raw = [c.encode("utf-8", "surrogatepass").replace(_MARK, b"\xff").replace(b" ", _MARK) for c in new]
        edges = np.cumsum([len(r) for r in raw])
        begin = 0
        while begin < len(raw):
            end = max(begin + 1, int(np.searchsorted(edges, (edges[begin - 1] if begin else 0) + TOGETHER)))
            self.known.update(zip(new[begin:end], self.best(raw[begin:end]), strict=True))
            begin = end
        self.held += sum(len(c) + len(self.known[c]) + PER_CHUNK for c in new)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), np.int32) for chunks in cut]


class Decoder:
    """Gives the text of ids back: byte pieces join to characters, markers are spaces, the first one goes."""

    def __init__(self, vocabulary: Vocabulary):
        self.table = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(MARKER, " ").encode() if ok else b"" for p, ok in zip(vocabulary.pieces, vocabulary.usable, strict=True)]

    def decode(self, ids) -> str:
        return b"".join(map(self.table.__getitem__, ids))[1:].decode("utf-8", "replace")


def _in_parts(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts, null as empty, each of about BATCH bytes at most, or of one text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    edges, begin = np.cumsum(lengths), 0
    while begin < len(lengths):
        end = max(begin + 1, int(np.searchsorted(edges, (edges[begin - 1] if begin else 0) + BATCH)))
        part = batch.slice(begin, end - begin)
        yield part, [t or "" for t in part.column(text).to_pylist()]
        begin = end


def _with(docs: DataFrame, keep: list[str], text: str, vocabulary: Vocabulary, fields: list[StructField], values: Callable) -> DataFrame:
    """The columns keep of docs, with fields added; values(encoder, decoder, texts) gives the arrays of a part.

    The trie is built once, by the driver; workers get its arrays. Texts come in and what is asked goes out, part by part.
    """
    shared = docs.sparkSession.sparkContext.broadcast((Encoder(vocabulary), Decoder(vocabulary)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = shared.value
        for batch in batches:
            for part, texts in _in_parts(batch, len(keep)):
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *values(encoder, decoder, texts)], [*keep, *(f.name for f in fields)])
            # What Arrow holds beyond the batch goes back, as workers share the executor's memory and live on.
            pa.default_memory_pool().release_unused()

    schema = StructType([*(docs.schema[c] for c in keep), *fields])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text")).mapInArrow(each, schema)


def _listed(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def encode_pieces(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """docs with an array<int> column of piece ids added, of the whole text.

    Null and empty texts have no ids. Texts may have any length; they are encoded in parts of about 1 MB of them. Equal
    texts have equal ids, repeated rows repeat them. An empty table gives an empty one. Other columns pass through, or
    those of keep; ValueError if one is named as the added one.
    """
    keep = docs.columns if keep is None else keep
    fresh(docs.select(*keep), out, "_text")
    return _with(docs, keep, text, vocabulary, [StructField(out, ArrayType(IntegerType()))], lambda e, d, texts: [_listed(e.arrays(texts))])


def round_trips(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all, if none are named) with token_ids, n_tokens, decoded_sha256 and round_trip added.

    Each text is encoded, its ids are decoded, and the decoded text (its lower-case hex digest of UTF-8 is given) is held
    against it. Other cases are as with encode_pieces, null counts as empty.
    """
    keep = docs.columns if keep is None else keep
    fields = [StructField("token_ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("decoded_sha256", StringType()), StructField("round_trip", BooleanType())]
    fresh(docs.select(*keep), "_text", *(f.name for f in fields))

    def values(encoder: Encoder, decoder: Decoder, texts: list[str]) -> list[pa.Array]:
        ids = encoder.arrays(texts)
        back = [decoder.decode(x.tolist()) for x in ids]
        sums = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]
        return [_listed(ids), pa.array([len(x) for x in ids], pa.int64()), pa.array(sums, pa.string()), pa.array([x == y for x, y in zip(back, texts, strict=True)], pa.bool_())]

    return _with(docs, keep, text, vocabulary, fields, values)


def decode_pieces(df: DataFrame, vocabulary: Vocabulary, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with the text of an array<int> column of piece ids added; null and empty arrays give an empty text."""
    fresh(df, out)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(shared.value)
        for arrays in batches:
            yield arrays.map(lambda x: decoder.decode(x.tolist()))

    return df.withColumn(out, decoded(F.coalesce(F.col(ids), F.array().cast("array<int>"))))
