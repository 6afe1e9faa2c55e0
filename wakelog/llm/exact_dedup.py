"""Exact dedup over an index of live digests: cuckoo filters in shards, before buckets of stored content records.

A text's *content record* is the SHA-256 of its normalised form with its length in bytes. The index deals records to shards
by their hash. A shard holds a cuckoo filter and its live records in buckets by digest (64 bits of the record). A record
that the filter has not seen is new and goes in unread; one that hits is verified against the bucket's stored records, byte
for byte. A filter that overflows is made anew at twice the size from the stored keys. Deleted records leave bucket and
filter. A shard is one group of bounded size, so tasks hold a few MB whatever the number of documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_parts, stored, text_or_empty

#: Marks in a bucket of the filter, and moves of a mark before the filter counts as full.
SLOTS, MOVES = 4, 200
#: Rows that a shard is laid out for.
SHARD_ROWS = 50_000


class CuckooFilter:
    """A set of 64-bit digests as 16-bit marks; each has two buckets. May say yes of a digest that it lacks, never no of one it has."""

    def __init__(self, buckets: int = 16, slots: bytes | None = None):
        """buckets: a power of two. slots: what an earlier filter's tobytes gave."""
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy()

    def tobytes(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The mark and both buckets of each digest."""
        mark = np.maximum((digests >> np.uint64(48)).astype(np.uint16), 1)
        first = (digests & np.uint64(len(self.slots) - 1)).astype(np.int64)
        return mark, first, first ^ self._turn(mark)

    def _turn(self, mark: np.ndarray) -> np.ndarray:
        """What leads from one bucket of a mark to the other."""
        return (mark.astype(np.int64) * 0x5BD1E995 >> 7) & (len(self.slots) - 1)

    def has(self, digests: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(digests)
        return ((self.slots[a] == mark[:, None]) | (self.slots[b] == mark[:, None])).any(axis=1)

    def add(self, digests: np.ndarray) -> bool:
        """False if a mark found no place; the filter has then lost one and must be made anew from the stored keys."""
        mark, a, b = self._places(digests)
        left = np.arange(len(digests))
        for bucket in (a, b):
            for slot in range(SLOTS):
                free = left[self.slots[bucket[left], slot] == 0]
                taken = free[np.unique(bucket[free], return_index=True)[1]]
                self.slots[bucket[taken], slot] = mark[taken]
                left = np.setdiff1d(left, taken, assume_unique=True)
        return all(self._move_in(int(b[i]), int(mark[i]), int(i)) for i in left)

    def _move_in(self, bucket: int, mark: int, seed: int) -> bool:
        """Put a mark into a bucket, whose marks make room by moving to their other buckets."""
        for turn in range(MOVES):
            row = self.slots[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = mark
                return True
            at = (seed * 2_654_435_761 + turn * 40_503 >> 5) % SLOTS
            row[at], mark = mark, int(row[at])
            bucket ^= int(self._turn(np.array([mark], np.uint16))[0])
        return False

    def remove(self, digests: np.ndarray) -> None:
        """Take out one mark for each digest. Only digests that were added may be removed."""
        for mark, *buckets in zip(*self._places(digests), strict=True):
            for bucket in buckets:
                at = np.flatnonzero(self.slots[bucket] == mark)
                if len(at):
                    self.slots[bucket, at[0]] = 0
                    break


def smaller(a, b):
    """The smaller id; null is larger than any."""
    return b if a is None else a if b is None else min(a, b)


def digests_of(contents: list[bytes]) -> np.ndarray:
    """64 bits of each content record, which begins with a hash."""
    return np.frombuffer(b"".join(c[:8] for c in contents), np.uint64)


class Shard:
    """The live records of one shard: for each its content, the smallest id that has it, and how many rows do."""

    def __init__(self, contents: Iterable[bytes] = (), keepers: Iterable = (), counts: Iterable[int] = (), slots: bytes | None = None):
        self.contents, self.keepers, self.counts = list(contents), list(keepers), list(counts)
        self.digests = digests_of(self.contents).tolist()
        self.buckets: dict[int, list[int]] = defaultdict(list)
        for i, d in enumerate(self.digests):
            self.buckets[d].append(i)
        self.filter = CuckooFilter(slots=slots) if slots else CuckooFilter()
        if not slots:
            self._admit(np.array(self.digests, np.uint64))

    def _admit(self, digests: np.ndarray) -> None:
        """Add digests, of stored records, to the filter; if it overflows, all stored ones to one of twice the size."""
        fits = self.filter.add(digests)
        while not fits:
            self.filter = CuckooFilter(2 * len(self.filter.slots))
            live = np.array([d for d, c in zip(self.digests, self.contents, strict=True) if c is not None], np.uint64)
            fits = self.filter.add(live)

    def _store(self, content: bytes, digest: int, keeper, count: int) -> None:
        self.buckets[digest].append(len(self.contents))
        for row, x in ((self.contents, content), (self.digests, digest), (self.keepers, keeper), (self.counts, count)):
            row.append(x)

    def find(self, content: bytes, digest: int) -> int | None:
        """The record with this very content, among those of its bucket."""
        return next((i for i in self.buckets.get(digest, ()) if self.contents[i] == content), None)

    def insert(self, contents: list[bytes], ids: list, counts: list[int]) -> None:
        digests = digests_of(contents)
        pending = np.arange(len(contents))
        while len(pending):
            seen = self.filter.has(digests[pending])
            unseen = pending[~seen]
            # Of equal newcomers one goes in unread; the others meet it in the next turn.
            new = unseen[np.unique(digests[unseen], return_index=True)[1]]
            for i in new.tolist():
                self._store(contents[i], int(digests[i]), ids[i], counts[i])
            self._admit(digests[new])
            strangers = []
            for i in pending[seen].tolist():
                at = self.find(contents[i], int(digests[i]))
                if at is None:
                    self._store(contents[i], int(digests[i]), ids[i], counts[i])
                    strangers.append(i)
                else:
                    self.counts[at] += counts[i]
                    self.keepers[at] = smaller(self.keepers[at], ids[i])
            self._admit(digests[strangers])
            pending = np.setdiff1d(unseen, new, assume_unique=True)

    def delete(self, contents: list[bytes]) -> None:
        """Records with these contents are no longer live; contents that are not live are passed over."""
        digests, gone = digests_of(contents), []
        for i in np.flatnonzero(self.filter.has(digests)).tolist():
            at = self.find(contents[i], int(digests[i]))
            if at is not None:
                self.buckets[self.digests[at]].remove(at)
                self.contents[at] = None
                gone.append(i)
        self.filter.remove(digests[gone])

    def rows(self) -> Iterator[tuple[bytes, object, int]]:
        return ((c, k, n) for c, k, n in zip(self.contents, self.keepers, self.counts, strict=True) if c is not None)


def normalised(text: Column) -> Column:
    """Each run of blanks as one space. Only runs that are not that already are matched."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def content_records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, content): SHA-256 and length of each normalised text; null counts as empty."""
    flat = docs.select(F.col(doc_id).alias("doc"), normalised(text_or_empty(text)).alias("flat"))
    length = F.unhex(F.lpad(F.hex(F.octet_length("flat").cast("long")), 16, "0"))
    return flat.select("doc", F.concat(F.unhex(F.sha2(F.col("flat").cast("binary"), 256)), length).alias("content"))


class ExactIndex:
    """Live content records in shards, written to the shared folder after each change.

    records() gives (content, keep_id, group_size). Shards are dealt by the records' hash, so one text, however frequent,
    is one record; each task gathers equal records of its batches before they move.
    """

    def __init__(self, spark: SparkSession, id_type: str, shards: int):
        self.shards, self.id_type = shards, id_type
        self.schema = f"shard int, content binary, keep_id {id_type}, group_size long, slots binary"
        self.state = spark.createDataFrame([], self.schema)

    def records(self) -> DataFrame:
        return self.state.where("content is not null").select("content", "keep_id", "group_size")

    def insert(self, records: DataFrame) -> None:
        """Take in rows (doc, content)."""
        self._change(records, False)

    def delete(self, records: DataFrame) -> None:
        """The contents of these rows (doc, content) are no longer live, whichever document brought them."""
        self._change(records, True)

    def _change(self, records: DataFrame, delete: bool) -> None:
        def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found: dict[bytes, list] = {}
                for doc, content in zip(b["doc"].to_pylist(), b["content"].to_pylist(), strict=True):
                    one = found.setdefault(content, [doc, 0])
                    one[0], one[1] = smaller(one[0], doc), one[1] + 1
                ids, counts = [x[0] for x in found.values()], [x[1] for x in found.values()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(ids, b.schema.field("doc").type), pa.array(counts, pa.int64())], ["content", "doc", "n"])

        def changed(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
            kept = [(c, k, n) for c, k, n in zip(old["content"].to_pylist(), old["keep_id"].to_pylist(), old["group_size"].to_pylist(), strict=True) if c is not None]
            slots = next((s for s in old["slots"].to_pylist() if s is not None), None)
            shard = Shard(*(zip(*kept, strict=True) if kept else ((), (), ())), slots)
            if delete:
                shard.delete(new["content"].to_pylist())
            else:
                shard.insert(new["content"].to_pylist(), new["doc"].to_pylist(), new["n"].to_pylist())
            rows = [*shard.rows(), (None, None, None)]
            contents, keepers, counts = zip(*rows, strict=True)
            key_of = pa.array([key[0].as_py()] * len(rows), pa.int32())
            slots = pa.array([None] * (len(rows) - 1) + [shard.filter.tobytes()], pa.binary())
            return pa.table([key_of, pa.array(contents, pa.binary()), pa.array(keepers, new.schema.field("doc").type), pa.array(counts, pa.int64()), slots], names=["shard", "content", "keep_id", "group_size", "slots"])

        partial = records.select("doc", "content").mapInArrow(gathered, f"content binary, doc {self.id_type}, n long")
        dealt = partial.withColumn("shard", F.pmod(F.xxhash64("content"), F.lit(self.shards)).cast("int"))
        both = self.state.groupBy("shard").cogroup(dealt.groupBy("shard"))
        self.state = stored(both.applyInArrow(changed, self.schema), "exact-index")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 2) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row: which row of its group of equal texts stays.

    Texts are equal if they are the same after each run of space and U+0009 to U+000D became one space (blanks at the ends
    stay, as one); equality is held on SHA-256 and length of that form. The row with the smallest id stays.

    Null and empty texts are equal. Null ids come after all others; a group of null ids alone has keep_id null. Rows that
    share id and text are one document to ``kept``, so all of them bear its mark, and each counts in group_size. An
    empty table gives an empty one. Of other columns, whatever their names, none is read.
    """
    records = stored(content_records(docs, doc_id, text), "content-records")
    index = ExactIndex(docs.sparkSession, records.schema["doc"].dataType.simpleString(), max(n_parts(docs.sparkSession), -(-records.count() // SHARD_ROWS)))
    part = F.pmod(F.xxhash64("doc"), F.lit(batches))
    for i in range(batches):
        index.insert(records.where(part == i))
    out = records.join(index.records(), "content")
    return out.select(F.col("doc").alias(doc_id), "keep_id", "group_size", F.col("doc").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex(F.substring("content", 1, 32))).alias("text_sha256"))
