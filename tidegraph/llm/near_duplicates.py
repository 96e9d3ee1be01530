"""Near-duplicates by an inverted join over signature coordinates.

A signature has `coordinates` values. Each is the combination of `width` words of the text, drawn consistently with
chances in proportion to their weight (the rarer, the heavier), so two texts agree on a coordinate with a chance of
their weighted overlap to the power of `width`. A text is posted under its coordinate-value pairs; the lists in which two
texts meet are counted, and pairs that meet in fewer than `match` are dropped. Prefix: texts that agree on at least
match + skip coordinates also meet in match lists if each leaves out its `skip` most frequent values, estimated from the
words' document frequencies in one order for all texts. Skip: in the lists, pairs that bounds rule out are passed over,
and the values left out are never merged; the exact check settles the rest.

Defined results: null, empty and short texts (below min_words distinct words) are in no pair; repeated rows of one id
count once; an id with several texts is paired by each; copies are one class; empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.lists import BLOCK, POSTING_DDL, Filter, list_pairs, pack, posted
from tidegraph.llm.similar import check_pairs, record_pairs
from tidegraph.llm.words import DF_SLOTS, document_frequencies, flat, mix, new_rows, word_sets
from tidegraph.session import cut

#: Bounds of a word's weight: no word is all but ignored, and misspelt ones don't outweigh the rest.
WEIGHTS = (0.5, 5.3)


def _sign(df: np.ndarray, n_texts: int, coordinates: int, width: int, skip: int, block: int):
    weights = np.log((n_texts + 2) / (df + 1)).clip(*WEIGHTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            batch = new_rows(batch, seen)
            if not batch.num_rows:
                continue
            c, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            words, row = flat(batch.column(2))
            start = np.searchsorted(row, np.arange(len(c)))
            known, inv = np.unique(words, return_inverse=True)
            weight, often = weights[known % DF_SLOTS], np.log(df[known % DF_SLOTS] + 1.0)
            keys = np.empty((len(c), coordinates), np.uint64)
            common = np.zeros((len(c), coordinates))
            for j in range(coordinates):
                key = np.full(len(c), j + 1, np.uint64)
                for r in range(width):
                    u = (mix(known.astype(np.uint64) + (np.uint64(j * width + r + 1) << np.uint64(33))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
                    order = np.argsort(-np.log(u + 1e-300) / weight, kind="stable")
                    rank = np.empty(len(known), np.int32)
                    rank[order] = np.arange(len(known), dtype=np.int32)
                    least = order[np.minimum.reduceat(rank[inv], start)]
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + known[least].astype(np.uint64))
                    common[:, j] += often[least]
                keys[:, j] = key
            bits, more = pack(words, row, len(c), side)
            keep = np.argsort(common, axis=1, kind="stable")[:, : coordinates - skip]
            many = keep.shape[1]
            # texts expected in a list, were its words independent: lists that are longer all the same only take longer
            expected = np.exp(np.take_along_axis(common, keep, axis=1) - (width - 1) * np.log(n_texts + 1.0))
            yield posted(np.take_along_axis(keys, keep, axis=1).ravel(), np.repeat(c, many), np.repeat(bits, many), np.repeat(more, many), np.ceil(expected).astype(np.int64).ravel(), block)

    return run


def signature_pairs(sets: DataFrame, threshold: float = 0.7, coordinates: int = 20, width: int = 3, match: int = 2, skip: int = 1, block: int = BLOCK) -> DataFrame:
    """(a, b, dot, similarity): pairs of classes with a Jaccard of at least the threshold, among those that meet in at least `match` lists."""
    df, n = document_frequencies(sets)
    postings = sets.select("c", "side", "w").mapInArrow(_sign(df, n, coordinates, width, skip, block), POSTING_DDL)
    met = list_pairs(postings, Filter(threshold), n * (coordinates - skip)).filter(F.col("hits") >= match)
    return check_pairs(sets, cut(met, "candidates"), threshold)


def near_duplicate_sets(rows: DataFrame, id_col: str, text_col: str, min_words: int = 12) -> DataFrame:
    return cut(word_sets(rows, id_col, text_col, None, min_words), "sets")


def near_duplicate_pairs(rows: DataFrame, id_col: str, text_col: str, threshold: float = 0.7, min_words: int = 12, **how: int) -> DataFrame:
    """(id_a, id_b): different ids whose texts are near-duplicates; see similar.record_pairs for large classes of copies."""
    sets = near_duplicate_sets(rows, id_col, text_col, min_words)
    pairs = cut(signature_pairs(sets, threshold, **how), "pairs")
    return record_pairs(sets, pairs)


def near_duplicate_groups(rows: DataFrame, id_col: str, text_col: str, threshold: float = 0.7, min_words: int = 12, **how: int) -> DataFrame:
    """(id, class_id, group_id, n_links): one row for each record with at least min_words distinct words.

    class_id is the smallest id with the same word set; group_id that of all classes linked directly or through others;
    n_links counts the other classes that the record's class is linked to.
    """
    from tidegraph.llm.components import connected_components

    sets = near_duplicate_sets(rows, id_col, text_col, min_words)
    pairs = cut(signature_pairs(sets, threshold, **how), "pairs")
    reps = sets.groupBy("c").agg(F.min("id").alias("class_id"))
    named = pairs.join(reps.select(F.col("c").alias("a"), F.col("class_id").alias("src")), "a").join(reps.select(F.col("c").alias("b"), F.col("class_id").alias("dst")), "b").select("src", "dst")
    groups = connected_components(named, "src", "dst")
    links = named.select(F.explode(F.array("src", "dst")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    out = sets.select("id", "c").distinct().join(reps, "c").join(groups.select(F.col("node").alias("class_id"), F.col("component").alias("group_id")), "class_id", "left").join(links, "class_id", "left")
    return out.select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
