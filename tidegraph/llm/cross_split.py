"""Overlaps between splits by a weighted cosine join over inverted lists.

Near-duplicates, as this project defines them, share at least the threshold of all their distinct words, so every word
weighs 1 and the dot product of two word vectors, their shared words, decides. The vectors are joined over coarser
terms: the words of a text fall into a fixed number of parts by a hash, and a term is what one part holds, the empty
part included. A word that one of two texts lacks changes one part. Residual norm: texts with n and m words that are
similar differ in at most d = (1 - threshold) / (1 + threshold) * (n + m) words, so of their parts, in one order for
all texts, rarest first, the first that they share stands among the d + 1 first of each, and only these are posted: every
pair meets. Maximum weight: no partner has more than n / threshold words, which bounds d; terms behind the d of equally
long partners are marked late, and two late terms are passed over.

A term that more than `often` texts hold is posted together with a second one: the next part that the two texts share
stands among the d + 2 first, so each such pair of terms is posted, and lists stay short however many texts there are.
Pairs that meet get their exact dot product, which decides. Longer texts get more parts: a level serves texts of up to
so many words, and a text is posted at each level that a partner of its may have (one or two). Counts of terms are kept in
a fixed number of slots. They only order terms and say which are posted with a second one, the same for all texts, so a
wrong count costs time and never a pair. Word hashes have 32 bits.

Defined results: null, empty and short texts, and records without a role in either side, are in no pair; repeated
roles and deliveries count once; a record with roles on both sides stands on both; empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.lists import BLOCK, POSTING_DDL, Filter, list_pairs, mark_late, pack, posted
from tidegraph.llm.similar import across_pairs, check_pairs
from tidegraph.llm.words import flat, mix, new_rows, word_sets
from tidegraph.session import cut

#: Slots in which terms are counted, and parts of the first level.
SLOTS, PARTS = 1 << 19, 32
#: The roles on the two sides of the join.
TRAIN, HELD_OUT = ("train",), ("validation", "calibration", "test")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Parts:
    """The terms of texts, by level, for a similarity threshold."""

    def __init__(self, threshold: float) -> None:
        self.threshold, self.apart = threshold, (1 - threshold) / (1 + threshold)
        self.first = int(0.4 * PARTS / self.apart) if self.apart > 0 else 1 << 30  # words served by the first level: d is at most 0.8 of its parts

    def level(self, n: np.ndarray) -> np.ndarray:
        return np.ceil(np.log2(np.maximum(n / self.first, 1)) - 1e-12).astype(int)

    def terms(self, words: np.ndarray, row: np.ndarray, n_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each level: the rows posted there, their terms (rows x parts), d for any partner of the level and d for partners of up to the same length."""
        n = np.bincount(row, minlength=n_rows)
        own, up = self.level(n), self.level(np.floor(n / self.threshold + 1e-9))
        start = np.cumsum(n) - n
        h = mix(words)
        for level in range(int(own.min()), int(up.max()) + 1) if n_rows else ():
            rows = np.flatnonzero((own <= level) & (level <= up))
            k, top = PARTS << level, self.first << level
            at = np.repeat(start[rows] - (np.cumsum(n[rows]) - n[rows]), n[rows]) + np.arange(n[rows].sum())
            place = np.repeat(np.arange(len(rows)) * k, n[rows]) + ((h[at] >> np.uint64(9)) % np.uint64(k)).astype(np.int64)
            term = np.zeros(len(rows) * k, np.uint64)
            np.add.at(term, place, mix(h[at] + _ODD))
            term = mix(term.reshape(len(rows), k) + (np.arange(k, dtype=np.uint64) + np.uint64(k)) * _ODD)
            size = n[rows]
            largest = np.minimum(np.floor(size / self.threshold + 1e-9), top)
            d = np.floor(self.apart * (size + largest) + 1e-9).astype(int)
            yield rows, term, d, np.minimum(d, np.floor(2 * self.apart * size + 1e-9).astype(int))


def _slot(term: np.ndarray) -> np.ndarray:
    return ((term >> np.uint64(11)) % np.uint64(SLOTS)).astype(np.int64)


def _in_order(term: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of each row, rarest first, and their counts."""
    seen = counts[_slot(term)]
    order = np.argsort(seen + (term >> np.uint64(11)).astype(np.float64) / 2**53, axis=1)
    return np.take_along_axis(term, order, 1), np.take_along_axis(seen, order, 1)


def _two(term: np.ndarray, seen: np.ndarray, d: np.ndarray, often: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """The pairs of terms posted in place of a frequent one: rows, joint term, and the two places."""
    for i in range(int(d.max(initial=-1)) + 1):
        hot = np.flatnonzero((i <= d) & (seen[:, i] > often))
        for j in range(i + 1, term.shape[1]):
            hot = hot[j <= d[hot] + 1]
            if not len(hot):
                break
            yield hot, mix(term[hot, i] * np.uint64(31) + term[hot, j]), i, j


def _term_counts(sets: DataFrame, parts: Parts, often: int = 0, counts: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Texts by slot of their terms (with counts: of their pairs of terms), and the postings to come; added up per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, seen = np.zeros(SLOTS, np.int64), 0, set()
        for batch in batches:
            batch = new_rows(batch, seen)
            words, row = flat(batch.column(2))
            for _, term, d, _ in parts.terms(words, row, batch.num_rows):
                total += int((d + 1).sum())
                if counts is None:
                    own += np.bincount(_slot(term).ravel(), minlength=SLOTS)
                else:
                    both = [x for _, x, _, _ in _two(*_in_order(term, counts), d, often)]
                    own += np.bincount(_slot(np.concatenate(both)), minlength=SLOTS) if both else 0
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, SLOTS).astype(np.int32)), pa.array(np.append(own[at], total))], names=["slot", "n"])

    got = sets.select("c", "side", "w").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS + 1, np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    # what terms share a slot by chance is taken off, so that rare terms stay rare however many texts there are
    return np.maximum(out[:SLOTS] - int(np.median(out[:SLOTS])), 0), int(out[SLOTS])


def _post(parts: Parts, ones: np.ndarray, twos: np.ndarray | None, often: int, block: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            batch = new_rows(batch, seen)
            if not batch.num_rows:
                continue
            c, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            words, row = flat(batch.column(2))
            bits, more = pack(words, row, len(c), side)
            for rows, term, d, even in parts.terms(words, row, len(c)):
                term, held = _in_order(term, ones)
                at = np.arange(term.shape[1])[None, :]
                r, i = np.nonzero((at <= d[:, None]) & (held <= often))
                key, late, bound = [term[r, i]], [i > even[r]], [held[r, i]]
                r = [r]
                for hot, both, i, j in _two(term, held, d, often):
                    r.append(hot), key.append(both), late.append(i > even[hot])
                    bound.append(held[hot, i] if twos is None else np.minimum(held[hot, i], twos[_slot(both)]))
                r = rows[np.concatenate(r)]
                yield posted(np.concatenate(key), c[r], mark_late(bits[r], np.concatenate(late)), more[r], np.concatenate(bound), block)

    return emit


def role_sides(splits: DataFrame, left: tuple[str, ...] = TRAIN, right: tuple[str, ...] = HELD_OUT) -> DataFrame:
    """(node_key, side): 1 for roles on the left, 2 on the right, 3 for both; other nodes have no row."""
    s = splits.filter(F.col("node_key").isNotNull() & F.col("role").isin(*left, *right))
    bit = F.when(F.col("role").isin(*left), 1).otherwise(2)
    return s.groupBy("node_key").agg(F.bit_or(bit).cast("int").alias("side"))


def split_sets(reviews: DataFrame, splits: DataFrame, min_words: int = 12) -> DataFrame:
    """Word sets of the reviews in the two sides: roles are joined before any text is read into words."""
    texts = reviews.filter("review_id is not null and text is not null").select(F.col("review_id").alias("node_key"), "text")
    return cut(word_sets(texts.join(role_sides(splits), "node_key"), "node_key", "text", "side", min_words), "sets")


def cosine_pairs(sets: DataFrame, threshold: float = 0.7, often: int = 16384, block: int = BLOCK) -> DataFrame:
    """(a, b, dot, similarity): all pairs of classes of different sides with that word overlap, and their exact dot product."""
    parts = Parts(threshold)
    ones, n_postings = _term_counts(sets, parts)
    twos = _term_counts(sets, parts, often, ones)[0] if ones.max(initial=0) > max(often, block) else None
    sc = sets.sparkSession.sparkContext
    held = sc.broadcast((ones.astype(np.int64), twos))  # SLOTS counts, twice at most

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _post(parts, *held.value, often, block)(batches)

    postings = sets.select("c", "side", "w").mapInArrow(emit, POSTING_DDL)
    return check_pairs(sets, cut(list_pairs(postings, Filter(threshold), n_postings), "candidates"), threshold)


def cross_split_pairs(reviews: DataFrame, splits: DataFrame, threshold: float = 0.7, min_words: int = 12, **how: int) -> DataFrame:
    """(id_a, id_b): near-duplicate reviews of which one has a role on the left and the other one on the right."""
    sets = split_sets(reviews, splits, min_words)
    pairs = cut(cosine_pairs(sets, threshold, **how), "pairs")
    return across_pairs(sets, pairs.select("a", "b"))


def overlap_counts(pairs: DataFrame, reviews: DataFrame, splits: DataFrame) -> DataFrame:
    """(role, source, n_records, n_pairs): held-out records that recur in training, and their pairs, by role and source."""
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("node_key"), F.struct("id_a", "id_b").alias("p"))
    roles = splits.filter(F.col("role").isin(*HELD_OUT)).select("node_key", "role").distinct()
    sources = reviews.groupBy("review_id").agg(F.min("source").alias("source"))
    x = ends.join(roles, "node_key").join(sources, F.col("node_key") == F.col("review_id"), "left")
    return x.groupBy("role", "source").agg(F.count_distinct("node_key").alias("n_records"), F.count_distinct("p").alias("n_pairs"))
