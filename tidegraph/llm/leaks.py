"""Evaluation texts inside training documents, by spaced-seed hashing.

Fixed masks over SPAN words ignore some positions. The words that a mask keeps are hashed at each position of every item
and of every document; equal hashes are hits, also where words at ignored positions were replaced. Around each hit the
texts are compared word by word on the hit's diagonal: the longest run of equal words, and the longest overlap whose
words differ in at most one of `per` (substitution-tolerant). A document leaks an item if the run has at least
`least` words or holds the whole of a shorter item.

Items go to the tasks in blocks of a fixed number of words, one pass over the documents for each block, so what is sent
never grows with the items; documents are scanned whole and never shuffled, only leaks are.

Defined results: null or empty documents and items leak nothing; items shorter than SPAN words are compared whole;
repeated ids are one result; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.words import Hashes, mix

#: The masks (1: the word counts) and their span.
SPAN = 8
MASKS = ((1, 1, 0, 1, 1, 0, 1, 1), (1, 1, 1, 0, 1, 0, 1, 1))

_WORD = re.compile(r"[^\W_]+")


@lru_cache(1)
def _invisible() -> re.Pattern:
    """Format characters (category Cf) and variation selectors, which show nothing of their own."""
    marks = [chr(x) for x in range(sys.maxunicode + 1) if unicodedata.category(chr(x)) == "Cf"]
    return re.compile("[" + "".join(map(re.escape, marks)) + "\\u034f\\ufe00-\\ufe0f]")


def normal_words(text: str) -> list[str]:
    """Words as leaks are judged by: NFKC, without format characters, lower case, runs of letters and digits."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _invisible().sub("", unicodedata.normalize("NFKC", _invisible().sub("", text))))
    return _WORD.findall(text.lower())


def _spaced(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = len(words) - SPAN + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j, on in enumerate(mask):
        if on and n > 0:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n].astype(np.uint64))
    return h


class Items:
    """One block of items: their words in one array, and a sorted list of spaced hashes for each mask."""

    def __init__(self, items: list[tuple[int, list[int]]]) -> None:
        self.ids = np.array([i for i, _ in items], np.int64)
        self.start = np.cumsum([0, *(len(w) for _, w in items)])
        self.words = np.array([x for _, w in items for x in w], np.uint32)
        self.tables = []
        for mask in MASKS:
            hs, at = [], []
            for k in range(len(items)):
                h = _spaced(self.words[self.start[k] : self.start[k + 1]], mask)
                hs.append(h)
                at.append(np.arange(len(h)) + self.start[k])
            h, p = (np.concatenate(hs), np.concatenate(at)) if hs else (np.empty(0, np.uint64), np.empty(0, np.int64))
            order = np.argsort(h, kind="stable")
            self.tables.append((h[order], p[order]))
        self.short = [k for k in range(len(items)) if 0 < len(items[k][1]) < SPAN]

    def matches(self, docs: list[np.ndarray], per: int, least: int) -> list[tuple[int, int, int, int, int]]:
        """(document, item, longest equal run, longest tolerant overlap, its equal words) of the items with an overlap of at
        least `least` words, or whole. All documents are hashed, looked up and compared along their hits' diagonals at once."""
        lens = np.array([len(d) for d in docs], np.int64)
        words, row = np.concatenate(docs) if docs else np.empty(0, np.uint32), np.repeat(np.arange(len(docs)), lens)
        base, n_items = np.cumsum(lens) - lens, len(self.ids)
        inside = np.flatnonzero(row[SPAN - 1 :] == row[: len(row) - SPAN + 1]) if len(row) >= SPAN else np.empty(0, np.int64)
        found = []
        for mask, (h, p) in zip(MASKS, self.tables):
            if not len(inside) or not len(h):
                continue
            d = _spaced(words, mask)[inside]
            at = np.searchsorted(h, d)
            hit = np.flatnonzero(h[np.minimum(at, len(h) - 1)] == d)
            n = np.searchsorted(h, d[hit], "right") - at[hit]
            pos = p[np.repeat(at[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            k, where = np.searchsorted(self.start, pos, "right") - 1, np.repeat(inside[hit], n)
            found.append(((row[where] * n_items + k) << 32) + (where - base[row[where]]) - (pos - self.start[k]) + (1 << 31))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        both = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        for part in range(0, len(both), 100_000):
            self._diagonals(both[part : part + 100_000], words, base, lens, per, least, best)
        for k in self.short:
            item = self.words[self.start[k] : self.start[k + 1]]
            for i, doc in enumerate(docs):
                if len(doc) >= len(item) and (np.lib.stride_tricks.sliding_window_view(doc, len(item)) == item).all(axis=1).any():
                    best[i, k] = (len(item),) * 3
        return [(i, k, *x) for (i, k), x in best.items() if x[1] >= min(least, int(self.start[k + 1] - self.start[k]))]

    def _diagonals(self, both: np.ndarray, words: np.ndarray, base: np.ndarray, lens: np.ndarray, per: int, least: int, best: dict) -> None:
        """Compare documents and items along diagonals, all in one array; only those that can hold a long enough overlap are looked into."""
        docs, ks = (both >> 32) // len(self.ids), (both >> 32) % len(self.ids)
        shifts = (both & ((1 << 32) - 1)) - (1 << 31)
        n_words = self.start[ks + 1] - self.start[ks]
        a = np.maximum(0, -shifts)
        size = np.minimum(n_words, lens[docs] - shifts) - a
        first = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(first, size)
        same = self.words[np.repeat(self.start[ks] + a, size) + step] == words[np.repeat(base[docs] + a + shifts, size) + step]
        sums = np.concatenate(([0], np.cumsum(same)))
        # a tolerant overlap of so many words has at least this many equal ones, and a stretch of `least` words with this many
        whole = np.minimum(least, n_words)
        may = sums[first + size] - sums[first] >= np.ceil(whole * (1 - 1 / per) - 1e-9)
        wide = np.flatnonzero(may & (size >= least) & (n_words >= least))
        n = size[wide] - least + 1
        at = np.repeat(first[wide], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if len(wide):
            dense = np.maximum.reduceat(sums[at + least] - sums[at], np.cumsum(n) - n)
            may[wide[dense < least - _misses(least, per)]] = False
        for i in np.flatnonzero(may).tolist():
            key = (int(docs[i]), int(ks[i]))
            got = _overlap(same[first[i] : first[i] + size[i]], per)
            old = best.get(key, (0, 0, 0))
            best[key] = (max(old[0], got[0]), *max(old[1:], got[1:]))


@lru_cache
def _misses(least: int, per: int) -> int:
    """Most different words that the best window of `least` words can have in a tolerant stretch of any length.

    A stretch of m words has at most m / per different ones. Its first and last window share 2 * least - m words if it is
    shorter than two windows; a longer one holds several windows side by side, the best of which has at most the mean.
    """
    short = [min(m // per, (m // per + 2 * least - m) // 2) for m in range(least, 2 * least)]
    return max([*short, *(m // per // (m // least) for m in range(2 * least, 2 * least * per))])


def _overlap(same: np.ndarray, per: int) -> tuple[int, int, int]:
    """Longest run of equal words; length and equal words of the longest stretch, ends equal, with at most one in `per` different."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.astype(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return 0, 0, 0
    run = int((ends - starts).max())
    # a stretch from run i to run j is tolerant if f(j) - g(i) >= 0 with f, g sums of +1 for equal and -(per - 1) for different words
    score = np.concatenate(([0], np.cumsum(np.where(same, 1, 1 - per))))
    equal = np.concatenate(([0], np.cumsum(same)))
    best = (run, run)
    for i, s in enumerate(starts.tolist()):
        ok = np.flatnonzero(score[ends[i:]] >= score[s])
        e = int(ends[i + ok[-1]])
        best = max(best, (e - s, int(equal[e] - equal[s])))
    return run, *best


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", least: int = 13, per: int = 8, block_words: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, run, overlap, matched, n_words, leaked) of each document and item with a tolerant overlap of `least` words or of the whole item.

    run: longest run of equal words; overlap, matched: length and equal words of the longest tolerant stretch; n_words:
    of the item; leaked: run >= least, or the whole item if it is shorter.
    """
    spark = docs.sparkSession
    out: DataFrame | None = None
    for block in _blocks(items.select(F.col(item_id).cast("long"), "text"), block_words):
        held = spark.sparkContext.broadcast(Items(block))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index, hashes = held.value, Hashes()
            length = np.diff(index.start)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                words = [np.array(hashes.of(normal_words(t)) if t else [], np.uint32) for t in texts]
                rows = [(ids[i], int(index.ids[k]), longest, overlap, matched, int(length[k]), longest >= min(least, int(length[k]))) for i, k, longest, overlap, matched in index.matches(words, per, least)]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=["doc", "item", "run", "overlap", "matched", "n_words", "leaked"])

        found = docs.select(F.col(doc_id).cast("long"), "text").mapInArrow(run, "doc bigint, item bigint, run int, overlap int, matched int, n_words int, leaked boolean")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "doc bigint, item bigint, run int, overlap int, matched int, n_words int, leaked boolean")
    best = out.groupBy("doc", "item").agg(F.max("run").alias("run"), F.max("overlap").alias("overlap"), F.max("matched").alias("matched"), F.max("n_words").alias("n_words"), F.max("leaked").alias("leaked"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "run", "overlap", "matched", "n_words", "leaked")


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, list[int]]]]:
    """Items in blocks of about block_words words, read one partition at a time."""
    hashes, block, words = Hashes(), [], 0
    for i, text in items.toLocalIterator():
        w = hashes.of(normal_words(text)) if text else []
        if i is None or not w:
            continue
        block.append((i, w))
        words += len(w)
        if words >= block_words:
            yield block
            block, words = [], 0
    if block:
        yield block


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """(benchmark, n_items, n_leaked, n_documents): how much of each benchmark stands in the corpus."""
    x = items.select("item_id", "benchmark").join(leaks.filter("leaked").select("item_id", "doc_id"), "item_id", "left")
    return x.groupBy("benchmark").agg(F.count_distinct("item_id").alias("n_items"), F.count_distinct(F.when(F.col("doc_id").isNotNull(), F.col("item_id"))).alias("n_leaked"), F.count_distinct("doc_id").alias("n_documents"))
