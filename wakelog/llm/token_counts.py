"""Token counts of a byte-level BPE with word ends: pre-tokens as ragged arrays, merged in the order of their ranks."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: White space of the normaliser's regular expressions.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What the file's own pre-tokeniser matches; fixed by the vocabulary.
_PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 1_000_000


def _byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class RankMerger:
    """Counts the symbols that survive BPE merging, over many byte strings at once."""

    def __init__(self, vocabulary: str):
        model = json.loads(vocabulary)
        vocab, end = model["model"]["vocab"], model["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in model["added_tokens"]]
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + end] for c in chars], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; len(made) where they don't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.made))

    def counts(self, words: list[bytes]) -> np.ndarray:
        """How many symbols each byte string ends in. Empty strings have 0."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[raw]
        full = np.flatnonzero(sizes)
        ends = np.cumsum(sizes)[full] - 1
        ids[ends] = self.final[raw[ends]]
        of = np.repeat(np.arange(len(words)), sizes)
        none, counts = len(self.made), np.zeros(len(words), np.int64)
        while ids.size:
            # Each pair of neighbours in a sequence has a rank; the sequence's lowest is applied at all its places.
            ranks = np.full(ids.size, none)
            inside = of[:-1] == of[1:]
            ranks[:-1][inside] = self.rank(ids[:-1][inside], ids[1:][inside])
            start = np.flatnonzero(np.diff(of, prepend=-1))
            lowest = np.minimum.reduceat(ranks, start)
            length = np.diff(start, append=ids.size)
            done = lowest == none
            counts[of[start[done]]] = length[done]
            hit = (ranks == np.repeat(lowest, length)) & (ranks < none)
            # In a run such as a a a the pairs overlap: from the left, every other one is taken.
            place = np.arange(ids.size)
            begin = hit & ~np.concatenate([[False], hit[:-1]])
            hit &= (place - np.maximum.accumulate(np.where(begin, place, 0))) % 2 == 0
            ids[hit] = self.made[ranks[hit]]
            keep = ~np.concatenate([[False], hit[:-1]]) & np.repeat(~done, length)
            ids, of = ids[keep], of[keep]
        return counts


def pretokens(text: str) -> list[str]:
    """The normalised pre-tokens of a text without special strings."""
    # Lower-casing goes letter by letter, so a last sigma is no special case.
    return _PRETOKEN.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


class TokenCounter:
    """Counts of whole texts; the counts of pre-tokens met before are remembered, up to a bound."""

    def __init__(self, vocabulary: str):
        self.merger = RankMerger(vocabulary)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.merger.special, key=len, reverse=True)))) if self.merger.special else None
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        found, special, unknown = [], [], {}
        for text in texts:
            parts = self.split.split(text) if self.split else [text]
            words = [w for p in parts for w in pretokens(p)]
            found.append(words)
            special.append(len(parts) - 1)
            unknown.update(dict.fromkeys(w for w in words if w not in self.known))
        new = list(unknown)
        got = dict(zip(new, self.merger.counts([w.encode() for w in new]).tolist(), strict=True))
        if len(self.known) + len(got) > REMEMBERED:
            self.known = {w: self.known[w] for words in found for w in words if w in self.known}
        self.known.update(got)
        return [s + sum(map(self.known.__getitem__, words)) for words, s in zip(found, special, strict=True)]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """docs with n_bytes, n_tokens (long) and over_limit (n_tokens > limit) added.

    vocabulary is the content of a tokenizer file of the word-end BPE kind; it goes to the tasks as a broadcast of its
    own fixed size. Special strings inside a text count as one token each; none is added.

    Null and empty texts have 0 tokens. Texts may have any length; a batch of texts is cut at about 2 MB of them.
    Repeated rows repeat their counts. An empty table gives an empty one. Other columns pass through; ValueError if one
    bears the name of an added column.
    """
    fresh(docs, "n_bytes", "n_tokens", "over_limit")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(shared.value)
        for texts in batches:
            out, held, size = [], [], 0
            for t in texts:
                held.append(t)
                size += len(t)
                if size > 2_000_000:
                    out += counter.count(held)
                    held, size = [], 0
            yield pd.Series(out + counter.count(held), dtype="int64")

    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({"n_bytes": F.octet_length(body).cast("long"), "n_tokens": counted(body)})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
