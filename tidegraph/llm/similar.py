"""From candidate pairs of classes to checked pairs of records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.words import flat

#: Slots of the bitmap that keeps texts without any candidate out of the check's shuffle.
END_SLOTS = 1 << 20


def _slot(c: np.ndarray) -> np.ndarray:
    return (c.view(np.uint64) >> np.uint64(7)) % np.uint64(END_SLOTS)


def ends_only(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(c, w) of the rows whose class may stand in a pair: a bitmap of fixed size, so some others may pass too."""
    slots = pairs.select(F.explode(F.array("a", "b")).alias("c")).mapInArrow(_slots, "s int").distinct().toArrow()["s"].to_numpy()
    bitmap = np.zeros(END_SLOTS, dtype=bool)
    bitmap[slots] = True
    held = sets.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.unpackbits(held.value).astype(bool)
        for batch in batches:
            c = batch.column(0).to_numpy()
            _, first = np.unique(c, return_index=True)
            keep = first[on[_slot(c[first])]]
            yield batch.take(pa.array(keep))

    return sets.select("c", "w").mapInArrow(run, "c bigint, w binary").groupBy("c").agg(F.first("w").alias("w"))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(batch.column(0).to_numpy())).astype(np.int32))], names=["s"])


def check_pairs(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, dot, similarity) of the pairs whose Jaccard over all their words is at least `least`.

    dot is the exact dot product of the two word vectors with weights of 1, that is the number of shared words.
    """
    w = ends_only(sets, pairs)
    x = pairs.select("a", "b").join(w.select(F.col("c").alias("a"), F.col("w").alias("wa")), "a")
    x = x.join(w.select(F.col("c").alias("b"), F.col("w").alias("wb")), "b").select("a", "b", "wa", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dot, similarity = overlaps(batch.column(2), batch.column(3))
            keep = pa.array(np.flatnonzero(similarity >= least - 1e-12))
            cols = [batch.column(0), batch.column(1), pa.array(dot), pa.array(similarity)]
            yield pa.RecordBatch.from_arrays([c.take(keep) for c in cols], names=["a", "b", "dot", "similarity"])

    return x.mapInArrow(run, "a bigint, b bigint, dot bigint, similarity double")


def overlaps(x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shared words, and shared by all distinct words, of the word sets of each row: one sort for a batch."""
    (p, r), (q, s) = flat(x), flat(y)
    n = len(x)
    both = np.concatenate([(r.astype(np.uint64) << np.uint64(32)) | p, (s.astype(np.uint64) << np.uint64(32)) | q])
    both.sort()
    dot = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=n)
    every = np.bincount(r, minlength=n) + np.bincount(s, minlength=n)
    return dot, dot / np.maximum(every - dot, 1)


def record_pairs(sets: DataFrame, pairs: DataFrame, whole: int = 256) -> DataFrame:
    """Pairs of records (id_a, id_b), id_a < id_b in bytes, from pairs of classes and from the copies inside a class.

    Classes of up to `whole` records are written out in full. A larger class is represented: its smallest record is
    paired with each copy and stands for it in pairs with other classes, so no link between different texts is lost and
    the rows stay in proportion to the records.
    """
    members = sets.select("c", "id").distinct()
    size = members.groupBy("c").agg(F.count("*").alias("m"), F.min("id").alias("rep"))
    grouped = members.join(size.filter("m > 1"), "c")
    few = grouped.filter(f"m <= {whole}").select("c", "id")
    big = grouped.filter(f"m > {whole}")
    out = few.select("c", F.col("id").alias("i")).join(few.select("c", F.col("id").alias("j")), "c").filter("i < j").select("i", "j")
    star = big.select(F.col("rep").alias("i"), F.col("id").alias("j")).filter("i <> j")
    stands = members.join(size.filter(f"m > {whole}").select("c", "rep"), "c", "left").filter("rep is null or id = rep").select("c", "id")
    linked = pairs.join(stands.select(F.col("c").alias("a"), F.col("id").alias("i")), "a").join(stands.select(F.col("c").alias("b"), F.col("id").alias("j")), "b")
    both = out.unionByName(star).unionByName(linked.filter("i <> j").select("i", "j"))
    return both.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


def across_pairs(sets: DataFrame, pairs: DataFrame, block: int = 256) -> DataFrame:
    """All pairs of records (id_a, id_b), id_a < id_b in bytes, of sides 1 and 2, from pairs of classes and from the copies inside a class.

    Every pair is written, however large the classes. The members on side 2 are split into blocks of about `block`
    records by a hash of the id, and those on side 1 meet each block by itself, so no task writes a hot class alone.
    """
    members = sets.select("c", "id", "side").distinct()
    left, right = members.filter("side & 1 = 1").select("c", F.col("id").alias("i")), members.filter("side & 2 = 2").select("c", F.col("id").alias("j"))
    blocks = right.groupBy("c").agg(F.ceil(F.count("*") / block).cast("int").alias("g"))
    right = right.join(blocks, "c").select(F.col("c").alias("y"), F.pmod(F.xxhash64("j"), F.col("g")).cast("int").alias("blk"), "j")
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    both = both.unionByName(blocks.select(F.col("c").alias("x"), F.col("c").alias("y"))).distinct()
    spread = both.join(blocks.withColumnRenamed("c", "y"), "y").join(left.withColumnRenamed("c", "x"), "x").select("y", "i", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("blk"))
    met = spread.join(right, ["y", "blk"]).filter("i <> j")
    return met.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()
