"""Inverted lists over tasks: postings meet by key, and only pairs that can still be similar leave a list.

A posting is (k, c, bits, more): the key of its list, the class of the text, and 128 bits that bound its similarity with
any other: 110 bits of parity of the words' hashes, the number of distinct words, the sides on which the class stands,
and whether the term is an early one. Where texts meet at the first term that they share, the one with fewer words may
have it among its late ones, but never both; where no term is marked late, all count as early. The parities of two
texts differ in at most as many bits as the texts differ in words, so no similar pair is lost in a list.

A list that is expected to outgrow `BLOCK` postings is split before the shuffle: its postings fall into blocks by a hash of
the class, and each pair of blocks is a list of its own, so a hot key is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.words import mix
from tidegraph.session import task_count

PARITY, SIZES, SIDES = 46, 8, 2
#: Postings of one list that a task compares at once, and postings for which one task is made.
BLOCK, SHARE = 1 << 16, 2_000_000
POSTING_DDL = "k bigint, c bigint, bits bigint, more bigint"
POSTING = pa.schema([(x, pa.int64()) for x in ("k", "c", "bits", "more")])
_S0, _D0, _E0 = PARITY, PARITY + SIZES, PARITY + SIZES + SIDES
_B0, _O0 = _E0 + 1, _E0 + 2  # in the upper block of a split list; in a list that compares its block with itself
_u = np.uint64


def pack(words: np.ndarray, row: np.ndarray, n_rows: int, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """bits and more of each row from its distinct words (sorted by row); terms are marked early."""
    start = np.searchsorted(row, np.arange(n_rows))
    size = np.diff(np.append(start, len(row)))
    at = mix(words) % _u(PARITY + 64)
    low = np.where(at < PARITY, _u(1) << np.minimum(at, _u(63)), _u(0))
    high = np.where(at < PARITY, _u(0), _u(1) << (np.maximum(at, _u(PARITY)) - _u(PARITY)))
    bits = np.bitwise_xor.reduceat(low, start) | (np.minimum(size, 255).astype(_u) << _u(_S0)) | (side.astype(_u) << _u(_D0)) | (_u(1) << _u(_E0)) | (_u(1) << _u(_O0))
    return bits, np.bitwise_xor.reduceat(high, start)


def mark_late(bits: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The bits with the terms marked that are not among the early ones of their text."""
    return np.where(late, bits & ~(_u(1) << _u(_E0)), bits)


def posted(k: np.ndarray, c: np.ndarray, bits: np.ndarray, more: np.ndarray, bound: np.ndarray, block: int = BLOCK) -> pa.RecordBatch:
    """A batch of postings; bound: the postings to expect in the list of a key, the same for all of them. Keys above the block are split."""
    g = -(-bound.astype(np.int64) // block)
    hot = np.flatnonzero(g > 1)
    k = k.astype(_u)
    if len(hot):
        cold = np.flatnonzero(g <= 1)
        g = g[hot]
        own = (mix(c[hot].view(_u)) % g.astype(_u)).astype(np.int64)
        times = g - 1
        at = np.repeat(np.arange(len(hot)), times)
        other = np.arange(len(at)) - (np.cumsum(times) - times)[at]
        b = own[at]
        other += other >= b
        lo, hi = np.minimum(b, other), np.maximum(b, other)
        mine = other == np.where(b < g[at] - 1, b + 1, b - 1)  # one list of each block compares it with itself
        src = hot[at]
        x = bits[src] & ~(_u(1) << _u(_O0)) | (b > other).astype(_u) << _u(_B0) | mine.astype(_u) << _u(_O0)
        split = mix(mix(k[src] + lo.astype(_u)) + hi.astype(_u))
        k, bits = np.concatenate([k[cold], split]), np.concatenate([bits[cold], x])
        c, more = np.concatenate([c[cold], c[src]]), np.concatenate([more[cold], more[src]])
    return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c), pa.array(bits.view(np.int64)), pa.array(more.view(np.int64))], schema=POSTING)


def _part(bits: np.ndarray, at: int, width: int) -> np.ndarray:
    return ((bits >> _u(at)) & _u((1 << width) - 1)).astype(np.int64)


class Filter:
    """Which pairs of postings of one list may be similar: Jaccard of word sets of at least `jaccard`."""

    def __init__(self, jaccard: float) -> None:
        self.jaccard = jaccard

    def __call__(self, x: np.ndarray, y: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
        nx, ny = _part(x, _S0, SIZES), _part(y, _S0, SIZES)
        apart = np.bitwise_count((x ^ y) & _u((1 << PARITY) - 1)).astype(np.int64) + np.bitwise_count(x2 ^ y2)
        most = (1 - self.jaccard) / (1 + self.jaccard) * (nx + ny) + 1e-9
        long = (nx == 255) | (ny == 255)
        ok = long | ((apart <= most) & (np.minimum(nx, ny) + 1e-9 >= self.jaccard * np.maximum(nx, ny)))
        sx, sy = _part(x, _D0, SIDES), _part(y, _D0, SIDES)
        ok &= (((sx & 1) & (sy >> 1)) | ((sx >> 1) & (sy & 1))).astype(bool)
        ok &= (((x ^ y) >> _u(_B0)) & _u(1) | (x >> _u(_O0)) & _u(1)).astype(bool)
        return ok

    def room(self, size: np.ndarray) -> np.ndarray:
        """Share of the differing bits that a text of that size brings to a pair; two shares bound a similar pair's."""
        return np.where(size == 255, 64, np.ceil(size * (1 - self.jaccard) / (1 + self.jaccard))).clip(0, 64).astype(np.uint8)


#: Runs of up to so many rows are compared one distance at a time over all runs, longer ones as a matrix in parts of at
#: most CELLS; matrices of at least LARGE have one limit for each pair of rooms, smaller ones a limit for each cell.
RUN, CELLS, LARGE = 24, 1 << 16, 1 << 20


class _Tiles:
    """Candidates of a matrix of 64 parity bits against as many: those that differ in at most rx + ry bits; its buffers are used again."""

    def __init__(self) -> None:
        self.xor, self.count, self.most, self.near = np.empty(CELLS, _u), np.empty(CELLS, np.uint8), np.empty(CELLS, np.uint8), np.empty(CELLS, bool)

    def __call__(self, x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (in x, in y); both sides are sorted by their room."""
        if len(x) * len(y) < LARGE:
            yield from self._cells(x, y, 0, 0, rx, ry)
            return
        ends_x, ends_y = np.flatnonzero(np.diff(rx, append=0)) + 1, np.flatnonzero(np.diff(ry, append=0)) + 1
        for a, b in zip(np.append(0, ends_x[:-1]), ends_x):
            for c, d in zip(np.append(0, ends_y[:-1]), ends_y):
                yield from self._cells(x[a:b], y[c:d], a, c, int(rx[a]) + int(ry[c]), None)

    def _cells(self, x: np.ndarray, y: np.ndarray, px: int, py: int, most: np.ndarray | int, more: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lo in range(0, len(y), CELLS):
            wide = min(len(y), lo + CELLS) - lo
            rows = max(1, CELLS // wide)
            for at in range(0, len(x), rows):
                high = min(len(x), at + rows) - at
                xor, count, limit, near = (z[: high * wide].reshape(high, wide) for z in (self.xor, self.count, self.most, self.near))
                np.bitwise_xor(x[at : at + high, None], y[None, lo : lo + wide], out=xor)
                np.bitwise_count(xor, out=count)
                if more is None:
                    np.less_equal(count, most, out=near)
                else:
                    np.add(most[at : at + high, None], more[None, lo : lo + wide], out=limit)
                    np.less_equal(count, limit, out=near)
                found = np.flatnonzero(near)
                if len(found):
                    yield found // wide + (at + px), found % wide + (lo + py)


def _pairs(k: np.ndarray, c: np.ndarray, bits: np.ndarray, more: np.ndarray, near: Filter, tiles: _Tiles) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within runs of equal k that pass the filter, each once a run; a class stands in a run once."""
    n = len(k)
    ends = np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, n) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(0, ends))
    a, b = [], []
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(p: np.ndarray, q: np.ndarray) -> None:
        held.append((p, q))
        if sum(len(x) for x, _ in held[-64:]) > CELLS or len(held) > 4096:
            settle()

    def settle() -> None:
        if not held:
            return
        p, q = (np.concatenate(z) for z in zip(*held))
        held.clear()
        apart = np.bitwise_count((bits[p] ^ bits[q]) & _u((1 << PARITY) - 1)) + np.bitwise_count(more[p] ^ more[q])
        some = np.flatnonzero(apart <= limit[p] + limit[q])
        p, q = p[some], q[some]
        ok = near(bits[p], bits[q], more[p], more[q])
        if ok.any():
            p, q = c[p[ok]], c[q[ok]]
            a.append(np.minimum(p, q))
            b.append(np.maximum(p, q))

    room = near.room(_part(bits, _S0, SIZES))
    limit = np.where(room >= 64, 127, room).astype(np.uint8)  # the sizes of the longest texts are not known
    short = np.repeat(sizes <= RUN, sizes)
    end = np.repeat(ends, sizes)
    i = np.flatnonzero(short)
    step = 1
    while len(i := i[i + step < end[i]]):
        for part in range(0, len(i), CELLS):
            keep(i[part : part + CELLS], i[part : part + CELLS] + step)
        step += 1
    side, early = _part(bits, _D0, SIDES), _part(bits, _E0, 1).astype(bool)
    for lo, hi in zip(ends[sizes > RUN] - sizes[sizes > RUN], ends[sizes > RUN]):
        own = lo + np.argsort(room[lo:hi], kind="stable")
        split = bool((side[own] != 3).any())
        x, y = (own[side[own] & 1 > 0], own[side[own] & 2 > 0]) if split else (own, own)
        # two late terms are never the first that a similar pair shares
        for x, y in ((x[early[x]], y), (x[~early[x]], y[early[y]])) if split else ((x, y),):
            if not len(x) or not len(y):
                continue
            for p, q in tiles(more[x], more[y], room[x], room[y]):
                p, q = x[p], y[q]
                # a pair that stands on both sides on either end is met from both; it counts from one
                ok = p < q if not split else (p < q) | ((p != q) & (side[p] & side[q] != 3))
                keep(p[ok], q[ok])
    settle()
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


_OUT = pa.schema([(x, pa.int64()) for x in ("a", "b")])


def _merge(near: Filter):
    """Pairs of each list over rows sorted by key and class; the last list of a batch is held until it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        tiles = _Tiles()

        def found(rows: list[np.ndarray]) -> pa.RecordBatch:
            k, c, bits, more = rows
            first = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
            if not first.all():  # one class from several tasks: its sides and marks are joined
                at = np.flatnonzero(first)
                k, c, bits, more = k[at], c[at], np.bitwise_or.reduceat(bits, at), more[at]
            return pa.RecordBatch.from_arrays([pa.array(z) for z in _pairs(k, c, bits, more, near, tiles)], schema=_OUT)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(j).to_numpy() if j < 2 else batch.column(j).to_numpy().view(np.uint64) for j in range(4)]
            rows = [np.concatenate(x) for x in zip(held, new)] if held else new
            k = rows[0]
            tail = int(np.searchsorted(k, k[-1]))
            if tail:
                yield found([x[:tail] for x in rows])
            held = [x[tail:].copy() for x in rows]
        if held:
            yield found(held)

    return run


def list_pairs(postings: DataFrame, near: Filter, n_postings: int = 0) -> DataFrame:
    """Distinct (a, b, hits), a < b: the classes that meet in some list and pass the filter, with the number of lists in which they met.

    One shuffle of the postings by key, into at least one task for each SHARE postings.
    """
    n = max(task_count(postings.sparkSession), -(-n_postings // SHARE))
    rows = postings.select("k", "c", "bits", "more").repartition(n, "k").sortWithinPartitions("k", "c")
    return rows.mapInArrow(_merge(near), "a bigint, b bigint").groupBy("a", "b").agg(F.count("*").alias("hits"))
