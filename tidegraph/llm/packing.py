"""Packing texts into sequences of a few permitted lengths, with little space left over.

Items are the texts' token counts; a text longer than the largest length is cut into pieces of that length and a rest,
and only then. Items are spread over groups by a hash of their id (the same at any cluster size) and each group is packed
on its own, largest items first: an item goes into the open bin it fits best (least space left). If none has room, the bin
to open is chosen by cost over all permitted lengths that hold the item, from the counts of the sizes still to come: a
length that one of them fills to the last token (or that the item fills alone) costs nothing, and of these the shortest is
taken, with that item placed at once; any other length is charged the space that what is to come can't be
expected to fill, by token of its length. At last each bin is downsized to the smallest permitted length that holds its
contents, so a bin that did not fill up costs no more than it must.

Defined results: null, empty and blank-token texts come out with no tokens and no bin; equal sizes are ordered by id;
repeated ids are packed once for each row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern of public byte-level BPE vocabularies with ranks.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are handed to the tokenizer in parts that end before a blank, so that no call grows with the text.
PART = 100_000


def parts(text: str) -> Iterator[str]:
    """The text in parts of about PART characters, each next one beginning with a blank before a letter, where no token crosses."""
    at = 0
    while len(text) - at > PART:
        cut = at + PART
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalnum() and cut + 1 < len(text) and text[cut + 1].isalnum()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_counts(docs: DataFrame, id_col: str, text_col: str, ranks: bytes | str) -> DataFrame:
    """(id, n_tokens) of whole texts; no shuffle. ranks: path of the vocabulary file, read on the driver."""
    path = str(ranks)
    held = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())  # one vocabulary file, about 1 MB
    name = Path(path).stem

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = {base64.b64decode(t): int(r) for t, r in (x.split() for x in held.value.splitlines() if x)}
        enc = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        for batch in batches:
            counts = [0 if t is None else sum(len(enc.encode_ordinary(p.encode("utf-8", "replace").decode("utf-8"))) for p in parts(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, n_tokens bigint")


def pack_group(sizes: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, final length of the bin and place in the bin of each item (all at most the largest length), items given largest first."""
    lengths = tuple(sorted(lengths))
    n = len(sizes)
    bins, place = np.empty(n, np.int64), np.empty(n, np.int64)
    open_: list[tuple[int, int]] = []  # (space left, bin) of open bins, sorted
    used: list[int] = []
    count: list[int] = []
    to_come = int(sizes.sum())
    small = int(sizes[-1]) if n else 0
    # items of a size stand together; those still to come are the first left[size] of them
    first: dict[int, int] = {}
    left: dict[int, int] = {}
    for i, size in enumerate(sizes.tolist()):
        first.setdefault(size, i)
        left[size] = left.get(size, 0) + 1

    def put(i: int, size: int, b: int) -> None:
        bins[i], place[i] = b, count[b]
        used[b] += size
        count[b] += 1

    for i, size in enumerate(sizes.tolist()):
        if i - first[size] >= left[size]:
            continue  # it has filled a bin before
        to_come -= size
        at = bisect_left(open_, (size, -1))
        if at < len(open_):
            room, b = open_.pop(at)
            put(i, size, b)
        else:
            b = len(used)
            used.append(0)
            count.append(0)
            room, other = _least_cost(size, lengths, to_come, small, lambda g, size=size, i=i: g <= size and left.get(g, 0) - (i - first[size] + 1 if g == size else 0) > 0)
            put(i, size, b)
            if other:
                left[other] -= 1
                put(first[other] + left[other], other, b)
                to_come -= other
                room -= other
        if room > size and room - size >= small:
            insort(open_, (room - size, b))
    final = np.array([lengths[bisect_left(lengths, u)] for u in used], dtype=np.int64)
    return bins, final[bins] if n else final, place


def _least_cost(size: int, lengths: tuple[int, ...], to_come: int, small: int, there: Callable[[int], bool]) -> tuple[int, int]:
    """The length to open for an item, and the size of an item that fills the rest of it exactly (0: none).

    Cost: expected loss by token of length. A length filled exactly costs nothing, the shortest such one is taken. A gap
    that the smallest item can't enter is lost for certain; any other gap as far as too little is to come; of
    equal costs the largest length is taken, whose gap can be filled in most ways.
    """
    best, cost = lengths[-1], float("inf")
    for length in lengths:
        if length >= size and (length == size or there(length - size)):
            return length, length - size
    for length in reversed(lengths):
        if length < size:
            break
        gap = length - size
        lost = gap if gap < small else max(0, gap - to_come)
        if lost / length < cost:
            best, cost = length, lost / length
    return best, 0


def pack(docs: DataFrame, id_col: str, text_col: str, ranks: str, lengths: tuple[int, ...] = (512, 1024, 2048, 4096), group_tokens: int = 20_000_000) -> DataFrame:
    """(id, piece, start, n_tokens, sequence_id, capacity, place): every text once, or in consecutive pieces if it alone exceeds the largest length.

    group_tokens: about so many tokens are packed together by one task; the unused space of a group is a few bins.
    """
    from tidegraph.session import cut

    top = max(lengths)
    sizes = cut(token_counts(docs, id_col, text_col, ranks), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    groups = max(1, -(-int(total) // group_tokens))
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / top).cast("int"), F.lit(1)) - 1)
    items = sizes.select("id", F.col("n_tokens").alias("all"), F.explode(pieces).alias("piece"))
    items = items.select("id", "piece", (F.col("piece").cast("long") * top).alias("start"), F.least(F.col("all") - F.col("piece").cast("long") * top, F.lit(top)).alias("n_tokens"), F.pmod(F.xxhash64("id", "piece"), F.lit(groups)).alias("g"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), ("id", "ascending"), ("piece", "ascending")])
        bins, final, place = pack_group(t.column("n_tokens").to_numpy(), lengths)
        names = pa.array([f"{key[0].as_py()}-{b}" for b in bins.tolist()], pa.string())
        return pa.table({"id": t["id"], "piece": t["piece"], "start": t["start"], "n_tokens": t["n_tokens"], "sequence_id": names, "capacity": final, "place": place})

    ddl = "id bigint, piece int, start bigint, n_tokens bigint, sequence_id string, capacity bigint, place bigint"
    packed = items.filter("n_tokens > 0").groupBy("g").applyInArrow(run, ddl)
    empty = items.filter("n_tokens = 0").selectExpr("id", "piece", "start", "n_tokens", "cast(null as string) sequence_id", "cast(null as bigint) capacity", "cast(null as bigint) place")
    return packed.unionByName(empty)


def packing_report(packed: DataFrame) -> DataFrame:
    """(capacity, n_sequences, n_items, tokens, unused, unused_share) by sequence length."""
    s = packed.filter("sequence_id is not null").groupBy("sequence_id", "capacity").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"))
    r = s.groupBy("capacity").agg(F.count("*").alias("n_sequences"), F.sum("items").alias("n_items"), F.sum("tokens").alias("tokens"))
    unused = F.col("capacity") * F.col("n_sequences") - F.col("tokens")
    return r.select("capacity", "n_sequences", "n_items", "tokens", unused.alias("unused"), F.round(unused / (F.col("capacity") * F.col("n_sequences")), 6).alias("unused_share"))
