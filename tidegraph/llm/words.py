"""Texts as sets of hashed words, shared by the joins on similar texts.

A word is a run of letters and digits in lower case, held as 32 bits of its xxh3 hash: two different words of one pair
of reviews share a hash with a chance of about one in a million.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Document frequencies are kept for so many slots of word hashes; slots, not words, bound what the driver and tasks hold.
DF_SLOTS = 1 << 17

_SETS = pa.schema([("id", pa.string()), ("c", pa.int64()), ("side", pa.int32()), ("n", pa.int32()), ("w", pa.binary())])
SETS_DDL = "id string, c bigint, side int, n int, w binary"


class Hashes(dict):
    """Word hashes, remembered up to a fixed number of words."""

    most = 200_000

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word) & 0xFFFFFFFF
        return h

    def of(self, words: Iterable[str]) -> list[int]:
        if len(self) > self.most:
            self.clear()
        return list(map(self.__getitem__, words))


def word_sets(rows: DataFrame, id_col: str, text_col: str, side_col: str | None = None, min_words: int = 12) -> DataFrame:
    """(id, c, side, n, w) of the texts with at least min_words distinct words.

    c names the class of texts with one set of hashes; w holds the distinct hashes of its words in rising order; side is 3 without a side column. No shuffle. Null ids and null, empty or blank
    texts have no row.
    """
    picked = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), (F.col(side_col) if side_col else F.lit(3)).cast("int").alias("side"))
    picked = picked.filter("id is not null and text is not null and side > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            keep, sizes, every = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                distinct = set(WORD.findall(text.lower()))
                if len(distinct) >= min_words:
                    keep.append(i)
                    sizes.append(len(distinct))
                    every += hashes.of(distinct)
            both = np.unique((np.repeat(np.arange(len(keep), dtype=np.uint64), sizes) << np.uint64(32)) | np.array(every, np.uint64))
            n = np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(keep)) if keep else np.empty(0, np.int64)
            offsets, data = np.append(0, np.cumsum(n) * 4).astype(np.int32), both.astype("<u4").tobytes()
            w = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            c = [xxhash.xxh3_64_intdigest(data[a:b]) - (1 << 63) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at).cast(pa.string()), pa.array(c, pa.int64()), batch.column(2).take(at), pa.array(n, pa.int32()), w], schema=_SETS)

    return picked.mapInArrow(run, SETS_DDL)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of a binary column, and the row of each; sorted by row, then hash."""
    if not len(column):
        return np.empty(0, "<u4"), np.empty(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    words = np.frombuffer(column.buffers()[2], "u1")[offsets[0] : offsets[-1]].view("<u4") if offsets[-1] > offsets[0] else np.empty(0, "<u4")
    return words, np.repeat(np.arange(len(column)), np.diff(offsets) // 4)


def new_rows(batch: pa.RecordBatch, seen: set, most: int = 500_000) -> pa.RecordBatch:
    """The rows whose first two columns this task has not met yet; what it remembers is bounded."""
    new = []
    for i, x in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
        if x not in seen:
            seen.add(x)
            new.append(i)
    if len(seen) > most:
        seen.clear()
    return batch.take(pa.array(new, pa.int64()))


def document_frequencies(sets: DataFrame) -> tuple[np.ndarray, int]:
    """Texts with a word, by slot of its hash, and the number of texts: over all rows, added up per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(DF_SLOTS + 1, dtype=np.int64)
        for batch in batches:
            words, _ = flat(batch.column(0))
            counts[:DF_SLOTS] += np.bincount(words % DF_SLOTS, minlength=DF_SLOTS)
            counts[DF_SLOTS] += batch.num_rows
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at])], names=["slot", "n"])

    got = sets.select("w").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(DF_SLOTS + 1, dtype=np.int64)
    counts[got["slot"].to_numpy()] = got["n"].to_numpy()
    return counts[:DF_SLOTS], int(counts[DF_SLOTS])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed multipliers of the public splitmix64 generator)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
