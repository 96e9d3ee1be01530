"""Causal typed edges between reviews, and operators on edge lists.

Edges run from an earlier whole second to a later one; events of one second see the same past.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.session import cut


def _seconds(reviews: DataFrame) -> DataFrame:
    return reviews.select("review_id", "reviewer_id", "target_id", F.floor(F.col("us") / 1_000_000).cast("long").alias("sec"))


def recent_edges(reviews: DataFrame, key: str, days: int, most: int, relation: str) -> DataFrame:
    """From the `most` latest events of the same key within `days` before; no self join.

    Time is cut into spans of twice `days`, so a key's log is spread over as many groups as it has spans; the events of
    the last `days` of a span are also needed in the next one. Sorted rows stream through _recent(): work is in line with
    the rows and edges, memory with a batch.
    """
    r = _seconds(reviews).filter(F.col(key).isNotNull())
    past = days * 86_400
    span = F.floor(F.col("sec") / (2 * past)).cast("long")
    x = r.select("review_id", F.col(key).alias("key"), "sec", span.alias("home"), F.explode(F.array_distinct(F.array(span, F.floor((F.col("sec") + past) / (2 * past)).cast("long")))).alias("span"))
    x = x.filter("span is not null").select("review_id", "key", "span", "sec", (F.col("span") == F.col("home")).alias("own")).repartition("key", "span").sortWithinPartitions("key", "span", "sec", "review_id")
    kind = dict(r.dtypes)["review_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _recent(batches, past, most)

    return x.mapInArrow(run, f"src {kind}, dst {kind}, available_at long").select("src", "dst", F.lit(relation).alias("relation"), "available_at")


def _recent(batches: Iterator[pa.RecordBatch], past: int, most: int) -> Iterator[pa.RecordBatch]:
    """(src, dst, available_at) of rows sorted by key, span, second and id: each own row's `most` last rows before its second, in the same key and span.

    From batch to batch it keeps the `most` last rows of the last second and the `most` before that second.
    """
    import numpy as np
    import pyarrow.compute as pc

    kept = None
    for b in batches:
        if not b.num_rows:
            continue
        t = (pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])).combine_chunks()
        n, held = t.num_rows, t.num_rows - b.num_rows
        sec, at = t.column("sec").to_numpy(), np.arange(n)
        new = np.ones(n, dtype=bool)
        new[1:] = pc.or_(*(pc.not_equal(t.column(c).slice(1), t.column(c).slice(0, n - 1)) for c in ("key", "span"))).to_numpy()
        group = np.maximum.accumulate(np.where(new, at, 0))
        new[1:] |= sec[1:] != sec[:-1]
        second = np.maximum.accumulate(np.where(new, at, 0))
        dst = held + np.flatnonzero(t.column("own").slice(held).to_numpy())
        src = second[dst][:, None] - np.arange(1, most + 1)
        ok = src >= group[dst][:, None]
        ok &= sec[np.maximum(src, 0)] >= (sec[dst] - past)[:, None]
        src, dst = src[ok], np.repeat(dst, ok.sum(axis=1))
        if len(src):
            ids = t.column("review_id").combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(src)), ids.take(pa.array(dst)), pa.array(sec[src])], names=["src", "dst", "available_at"])
        last = second[-1]
        kept = t.take(pa.array(np.r_[max(group[-1], last - most) : last, max(last, n - most) : n]))


def same_reviewer_edges(reviews: DataFrame, days: int = 30, most: int = 10) -> DataFrame:
    return recent_edges(reviews, "reviewer_id", days, most, "same_reviewer")


def same_target_edges(reviews: DataFrame, days: int = 7, most: int = 20) -> DataFrame:
    return recent_edges(reviews, "target_id", days, most, "same_target")


def co_target_edges(reviews: DataFrame, days: int = 30, least: int = 2, most: int = 10, rows: int = 400_000, often: int = 200) -> DataFrame:
    """From the latest event of each of the reviewers who touched at least `least` of the reviewer's recent targets.

    A target is held while the reviewer's last touch of it is at most `days` old. Time is cut into spans of `days`; an event
    needs only its own span and the one before, and these are compared in one task. Spans of more than `rows` rows are
    split by the other reviewer, whose best are then ranked together. See _meetings().
    """
    r = _seconds(reviews).filter("reviewer_id is not null and target_id is not null")
    span = F.floor(F.col("sec") / (days * 86_400)).cast("long")
    sized = r.groupBy(span.alias("span")).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.count("*").alias("spans")).first()
    shards = max(1, -(-2 * (sized.most or 0) // rows))
    x = r.select("*", F.explode(F.array(F.struct(span.alias("span"), F.lit(True).alias("own")), F.struct((span + 1).alias("span"), F.lit(False).alias("own")))).alias("s")).select("review_id", "reviewer_id", "target_id", "sec", "s.*")
    x = x.withColumn("counts", F.pmod(F.xxhash64("reviewer_id"), F.lit(shards)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("counts", F.col("counts") == F.col("shard"))
    x = x.repartition(min(2 * (sized.spans + 1) * shards, 4000), "span", "shard")
    kind = dict(r.dtypes)

    def run(t: pa.Table) -> pa.Table:
        return _meetings(t, days * 86_400, least, most, often)

    met = x.groupBy("span", "shard").applyInArrow(run, f"src {kind['review_id']}, dst {kind['review_id']}, other {kind['reviewer_id']}, sec long, t long, shared long")
    top = met.withColumn("rk", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("shared"), "other", "t"))).filter(F.col("rk") <= most)
    e = top.groupBy("dst", "other").agg(F.max(F.struct("sec", "src")).alias("e"))  # an id that stands at several times
    return e.select("e.src", "dst", F.lit("co_target").alias("relation"), F.col("e.sec").alias("available_at"))


def _meetings(t: pa.Table, past: int, least: int, most: int, often: int) -> pa.Table:
    """(src, dst, other, sec, t, shared) of the events of one span: the others who hold at least `least` targets with an event's reviewer.

    Reviewers with few events: the holders of each of their targets are counted for each event. Those with more than
    `often`: targets held without a break are intervals; where the reviewer's and another's meet, the other's count goes up
    and down again, and a heap gives the best at each event. The work follows touches, not pairs of events.
    """
    import heapq

    import numpy as np
    import pyarrow.compute as pc

    def codes(c: str) -> tuple[np.ndarray, pa.Array]:
        d = t.column(c).combine_chunks().dictionary_encode()
        d = d.chunk(0) if isinstance(d, pa.ChunkedArray) else d
        order = pc.sort_indices(d.dictionary)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        return rank[d.indices.to_numpy()], d.dictionary.take(order)

    out: list[tuple[np.ndarray, ...]] = []
    (rev, revs), (who, whos), (tgt, _) = codes("review_id"), codes("reviewer_id"), codes("target_id")
    sec, own, counts = t.column("sec").to_numpy(), t.column("own").to_numpy(), t.column("counts").to_numpy()
    first, wide = int(sec.min()) - past - 2, int(sec.max() - sec.min()) + 2 * past + 8
    key = lambda o, s: o * wide + (s - first)
    # events by reviewer and time: a reviewer's recent targets, and the last event before a time
    by = np.lexsort((rev, sec, who))
    at, rev_at, tgt_at = key(who[by], sec[by]), rev[by], tgt[by]
    # touches of others by target and time, each until the next one by the same reviewer
    o = np.flatnonzero(counts)
    o = o[np.lexsort((sec[o], who[o], tgt[o]))]
    nxt = np.full(len(o), np.iinfo(np.int64).max)
    again = (tgt[o][1:] == tgt[o][:-1]) & (who[o][1:] == who[o][:-1])
    nxt[:-1][again] = sec[o][1:][again]
    line = np.argsort(key(tgt[o], sec[o]), kind="stable")
    held_at, held_by, held_to = key(tgt[o], sec[o])[line], who[o][line], nxt[line]

    def runs(ix: np.ndarray) -> tuple[np.ndarray, ...]:
        """Intervals (target, reviewer, from, to] of touches ix, sorted by target, reviewer and time, without a gap above `past`."""
        a, b, s = tgt[ix], who[ix], sec[ix]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (s[1:] - s[:-1] > past)] if len(ix) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        return a[start], b[start], s[start], s[np.r_[start[1:], len(ix)] - 1] + past if len(ix) else s

    dst = np.unique(np.stack([who[own], sec[own], rev[own]], 1), axis=0) if own.any() else np.zeros((0, 3), np.int64)
    lo, hi = np.searchsorted(at, key(dst[:, 0], dst[:, 1] - past)), np.searchsorted(at, key(dst[:, 0], dst[:, 1]))
    dst, lo, hi = (v[hi - lo >= least] for v in (dst, lo, hi))
    heads = np.flatnonzero(np.r_[True, dst[1:, 0] != dst[:-1, 0]]) if len(dst) else np.zeros(0, np.int64)
    seen = np.zeros(len(whos), dtype=np.int64)
    others = runs(o)
    for h, end in zip(heads, np.r_[heads[1:], len(dst)]):
        me = dst[h, 0]
        if end - h <= often:
            for i in range(h, end):
                targets, when = np.unique(tgt_at[lo[i] : hi[i]]), dst[i, 1]
                if len(targets) < least:
                    continue
                a, b = np.searchsorted(held_at, key(targets, when - past)), np.searchsorted(held_at, key(targets, when))
                parts = [held_by[x:y][held_to[x:y] >= when] for x, y in zip(a, b)]
                for p in parts:
                    seen[p] += 1
                every = np.concatenate(parts)
                found = np.unique(every[seen[every] >= least])
                found = found[found != me]
                if len(found):
                    n = seen[found]
                    best = np.argsort(-n, kind="stable")[:most]
                    out.append((np.full(len(best), i), found[best], n[best]))
                seen[every] = 0
            continue
        begins = dst[h, 1]
        mine = np.flatnonzero(who == me)
        mt, _, ms, me_to = runs(mine[np.lexsort((sec[mine], tgt[mine]))])
        a, b = np.searchsorted(others[0], mt), np.searchsorted(others[0], mt, side="right")
        n = b - a
        ix = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        up, down, by_other = np.maximum(others[2][ix], np.repeat(ms, n)), np.minimum(others[3][ix], np.repeat(me_to, n)), others[1][ix]
        ok = (up < down) & (down >= begins) & (by_other != me)
        up, down, by_other = up[ok], down[ok], by_other[ok]
        if not len(up):
            continue
        names, by_other = np.unique(by_other, return_inverse=True)
        size, early, last = len(names), up < begins, dst[end - 1, 1]
        cnt = np.bincount(by_other[early], minlength=size).tolist()
        later, gone = ~early & (up < last), down < last
        when = np.r_[up[later], down[gone]]
        order = np.argsort(when, kind="stable")
        when = when[order].tolist() + [1 << 62]
        moved, step = np.r_[by_other[later], by_other[gone]][order].tolist(), np.r_[np.ones(later.sum(), np.int64), -np.ones(gone.sum(), np.int64)][order].tolist()
        heap = [j - c * size for j, c in enumerate(cnt) if c >= least]
        heapq.heapify(heap)
        push, pop, u = heapq.heappush, heapq.heappop, 0
        rows_, best_, t_last, best = [], [], None, []
        for i, now in zip(range(h, end), dst[h:end, 1].tolist()):
            if now != t_last:
                while when[u] < now:
                    j = moved[u]
                    c = cnt[j] = cnt[j] + step[u]
                    if c >= least:
                        push(heap, j - c * size)
                    u += 1
                best, before, t_last = [], None, now
                while heap and len(best) < most:
                    k = pop(heap)
                    if k != before and cnt[k % size] == -(k // size):
                        best.append(k)
                    before = k
                for k in best:
                    push(heap, k)
            rows_ += [i] * len(best)
            best_ += best
        k = np.array(best_, dtype=np.int64)
        out.append((np.array(rows_, dtype=np.int64), names[k % size], -(k // size)))
    i, other, shared = (np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    before = np.searchsorted(at, key(other, dst[i, 1])) - 1  # a held target means an event in these two spans
    return pa.table({"src": revs.take(pa.array(rev_at[before])), "dst": revs.take(pa.array(dst[i, 2])), "other": whos.take(pa.array(other)), "sec": pa.array(at[before] - other * wide + first, pa.int64()), "t": pa.array(dst[i, 1]), "shared": pa.array(shared)})


def causal_graph(reviews: DataFrame) -> DataFrame:
    return same_reviewer_edges(reviews).unionByName(same_target_edges(reviews)).unionByName(co_target_edges(reviews))


def semantic_edges(vectors: DataFrame, id_col: str, block: str, order: str, vector: str, least: float = 0.9, most: int = 5) -> DataFrame:
    """From the `most` nearest earlier vectors of the same block with at least that cosine."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    v = vectors.select(F.col(id_col).alias("id"), F.col(block).alias("blk"), F.col(order).alias("o"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    v = v.withColumn("v", F.transform("v", lambda x: x / norm(F.col("v"))))
    a, b = v.alias("a"), v.alias("b")
    dot = F.aggregate(F.zip_with("a.v", "b.v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    p = a.join(b, (F.col("a.blk") == F.col("b.blk")) & (F.col("a.o") < F.col("b.o"))).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.round(dot, 6).alias("cosine")).filter(F.col("cosine") >= least)
    return p.withColumn("rk", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("cosine"), "src"))).filter(F.col("rk") <= most).drop("rk")


def edge_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n_edges"), F.count_distinct("dst").alias("n_dst"), F.min("available_at").alias("first_at"), F.max("available_at").alias("last_at"))


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(review_id, in_degree, available): zeros included."""
    d = edges.groupBy("dst").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return nodes.select("review_id").join(d, F.col("review_id") == F.col("dst"), "left").select("review_id", n.alias("in_degree"), (n > 0).alias("available"))


def binary_adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once for each relation."""
    e = edges.select("relation", "src", "dst")
    return e.unionByName(e.select("relation", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def upstream(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(hop, src, dst, relation): edges on paths of up to `hops` steps into the seeds (review_id)."""
    frontier, out = seeds.select(F.col("review_id").alias("dst")).distinct(), None
    for h in range(1, hops + 1):
        step = edges.join(frontier, "dst", "left_semi").select(F.lit(h).alias("hop"), "src", "dst", "relation")
        out = step if out is None else out.unionByName(step)
        frontier = step.select(F.col("src").alias("dst")).distinct()
    return out.groupBy("src", "dst", "relation").agg(F.min("hop").alias("hop"))


def sample_neighbours(edges: DataFrame, fanout: int = 10, seed: int = 42) -> DataFrame:
    """All in-edges of nodes with up to `fanout`; else `fanout` seeded draws with replacement, repeats dropped."""
    w = Window.partitionBy("relation", "dst")
    e = edges.select("relation", "src", "dst").distinct()
    e = e.withColumn("at", F.row_number().over(w.orderBy("src")) - 1).withColumn("deg", F.count("*").over(w))
    few = e.filter(F.col("deg") <= fanout).select("relation", "src", "dst")
    many = e.filter(F.col("deg") > fanout)
    draws = many.select("relation", "dst", "deg").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(fanout))))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "relation", F.col("dst").cast("string"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long")
    draws = draws.select("relation", "dst", F.pmod(u, F.col("deg")).cast("int").alias("at")).distinct()
    return few.unionByName(many.join(draws, ["relation", "dst", "at"]).select("relation", "src", "dst"))


def neighbour_mean(edges: DataFrame, features: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(dst, relation, mean): element-wise mean of the in-neighbours' vectors; sums are combined before they move, so a hub costs a vector a task."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    x = edges.select("relation", "src", "dst").join(features.select(F.col(id_col).alias("src"), array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("x")), "src")
    return x.groupBy("dst", "relation").agg(vector_to_array(Summarizer.mean(F.col("x"))).alias("mean"))


def relational_layer(edges: DataFrame, features: DataFrame, weights: dict, relu: bool = True) -> DataFrame:
    """(review_id, h): for each node its own vector times weights["self"], plus the mean over the relations that reach it of
    their neighbours' mean times weights[relation], plus weights["bias"]; negative values become 0 where relu is set.

    features: (review_id, h). The weights are a few matrices; rows pass through Arrow batches.
    """
    import numpy as np

    names = sorted(k for k in weights if k not in ("self", "bias"))
    held = features.sparkSession.sparkContext.broadcast({k: np.asarray(v, dtype=np.float64) for k, v in weights.items()})
    m = neighbour_mean(edges.filter(F.col("relation").isin(*names)), features, "review_id", "h").groupBy(F.col("dst").alias("review_id"))
    m = m.agg(*(F.first(F.when(F.col("relation") == n, F.col("mean")), ignorenulls=True).alias(f"m{i}") for i, n in enumerate(names)))
    x = features.select("review_id", "h").join(m, "review_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for b in batches:
            if not b.num_rows:
                continue
            own = np.array(b.column(1).to_pylist(), dtype=np.float64)
            reached, total = np.zeros(len(own)), np.zeros((len(own), w["self"].shape[1]))
            for i, n in enumerate(names):
                at = np.flatnonzero(b.column(2 + i).is_valid().to_numpy(zero_copy_only=False))
                if len(at):
                    total[at] += np.array(b.column(2 + i).take(pa.array(at)).to_pylist(), dtype=np.float64) @ w[n]
                    reached[at] += 1
            out = own @ w["self"] + total / np.maximum(reached, 1)[:, None] + w.get("bias", 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(np.maximum(out, 0) if relu else out), pa.list_(pa.float64()))], names=["review_id", "h"])

    return x.mapInArrow(run, f"review_id {dict(features.dtypes)['review_id']}, h array<double>")


def relational_stack(edges: DataFrame, features: DataFrame, layers: list[dict], head: tuple[list[float], float]) -> DataFrame:
    """(review_id, logit): the layers one after the other, each over its own edges written once, and a linear head."""
    h = features.select("review_id", "h")
    for w in layers:
        h = cut(relational_layer(edges, h, w), "layer")
    weight, bias = F.array(*(F.lit(float(x)) for x in head[0])), float(head[1])
    return h.select("review_id", (F.aggregate(F.zip_with("h", weight, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) + bias).alias("logit"))


def of_relation(edges: DataFrame, *relations: str) -> DataFrame:
    return edges.filter(F.col("relation").isin(*relations))


def layer_samples(edges: DataFrame, seeds: DataFrame, fanouts: tuple[int, ...] = (10, 5), seed: int = 42) -> DataFrame:
    """(layer, relation, src, dst): sampled in-edges of the seeds, then of what they reach, with a fanout for each layer (the last layer first)."""
    if not fanouts or any(f < 1 for f in fanouts):
        raise ValueError("a positive fanout for each layer is needed")
    frontier, out = seeds.select(F.col("review_id").alias("dst")).distinct(), None
    for layer in range(len(fanouts), 0, -1):
        step = cut(sample_neighbours(edges.join(frontier, "dst", "left_semi"), fanouts[len(fanouts) - layer], seed + layer).select(F.lit(layer).alias("layer"), "relation", "src", "dst"), "sampled")
        out = step if out is None else out.unionByName(step)
        frontier = frontier.unionByName(step.select(F.col("src").alias("dst"))).distinct()
    return out


def receptive_field(edges: DataFrame, seeds: DataFrame, hops: int = 2, max_edges: int = 100) -> DataFrame:
    """The first max_edges edges, in (available_at, src, dst, relation) order, on paths of up to `hops` steps into the seeds."""
    e = edges.select("src", "dst", "relation", "available_at")
    near = upstream(e, seeds, hops)
    e = e.groupBy("src", "dst", "relation").agg(F.min("available_at").alias("available_at"))
    return e.join(near, ["src", "dst", "relation"]).orderBy("available_at", "src", "dst", "relation").limit(max_edges)


def shared_target_pairs(pairs: DataFrame, least: int = 2, block: int = 2048, large: int = 64, hot: int = 1000) -> DataFrame:
    """(a, b, shared, weight) of reviewers a < b with at least `least` targets in common; weight is 2 * shared - 1.

    Targets are taken rarest first. Two reviewers who share `least` targets share one that is not among the last
    least - 1 of either, so only the others are posted: the pairs of a hot target don't meet on it alone. A pair counts
    in the list of the first target that it shares, from the two target lists. Lists above `block` are split into blocks.
    Reviewers of more than `large` targets are few; their pairs are counted target by target.
    The up to 63 most frequent targets of more than `hot` reviewers are bits of a mask and are not posted: pairs with
    `least` of them in common come from the masks, block against block (_mask_pairs), the others share a posted target.
    """
    p = cut(pairs.filter("reviewer_id is not null and target_id is not null").select("reviewer_id", "target_id").distinct(), "touches")
    n = p.groupBy("reviewer_id").agg(F.count("*").alias("n"))
    many, own = n.filter(F.col("n") > large).select("reviewer_id"), p.join(n.filter((F.col("n") >= least) & (F.col("n") <= large)), "reviewer_id")
    often = cut(p.groupBy("target_id").agg(F.count("*").alias("f")), "often")
    top = often.filter(F.col("f") > hot).orderBy(F.desc("f"), "target_id").limit(63).collect()
    bits = F.broadcast(p.sparkSession.createDataFrame([(r.target_id, 1 << i) for i, r in enumerate(top)], f"target_id {dict(p.dtypes)['target_id']}, bit bigint"))
    sized = own.join(often, "target_id").join(bits, "target_id", "left").groupBy("reviewer_id").agg(F.array_sort(F.collect_list(F.struct(F.col("bit").isNotNull().alias("hot"), "f", "target_id"))).alias("x"), F.coalesce(F.sum("bit"), F.lit(0)).alias("mask"))
    lists = cut(sized.select("reviewer_id", F.transform("x", lambda x: x["target_id"]).alias("ts"), "mask", F.transform(F.filter("x", lambda x: ~x["hot"] & (x["f"] > 1)), lambda x: x["target_id"]).alias("rare")), "lists")
    post = cut(lists.select("reviewer_id", "ts", "mask", F.explode(F.expr(f"slice(ts, 1, size(ts) - greatest({least - 1}, cast(bit_count(mask) as int)))")).alias("target_id")), "posted")
    g = post.groupBy("target_id").agg(F.ceil(F.count("*") / block).cast("int").alias("g")).filter("g > 0")
    x = post.join(g, "target_id").withColumn("blk", F.pmod(F.xxhash64("reviewer_id"), F.col("g")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    x = x.select("target_id", F.least("blk", "o").alias("lo"), F.greatest("blk", "o").alias("hi"), "blk", "reviewer_id", "ts", "mask")
    y = x.select("target_id", "lo", "hi", F.col("blk").alias("blk_b"), F.col("reviewer_id").alias("b"), F.col("ts").alias("tb"), F.col("mask").alias("mask_b"))
    met = x.withColumnRenamed("reviewer_id", "a").join(y, ["target_id", "lo", "hi"]).filter(f"a < b and (lo = hi or blk <> blk_b) and bit_count(mask & mask_b) < {least}")
    met = met.select("a", "b", "target_id", F.array_intersect("ts", "tb").alias("both")).filter(F.col("both")[0] == F.col("target_id"))
    s = met.select("a", "b", F.size("both").cast("long").alias("shared"))
    if len(top) >= least:
        m = lists.filter(f"bit_count(mask) >= {least}").select("reviewer_id", "mask", "rare")
        blocks = -(-m.count() // (4 * block))
        m = m.withColumn("blk", F.pmod(F.xxhash64("reviewer_id"), F.lit(max(blocks, 1))).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))
        m = m.select(F.least("blk", "o").alias("lo"), F.greatest("blk", "o").alias("hi"), "blk", "reviewer_id", "mask", "rare").repartition(max(1, min(blocks * (blocks + 1), 4000)), "lo", "hi")
        kind = dict(p.dtypes)["reviewer_id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _mask_pairs(batches, least)

        s = s.unionByName(m.groupBy("lo", "hi").applyInArrow(run, f"a {kind}, b {kind}, shared bigint"))
    big = p.join(many, "reviewer_id", "left_semi").select(F.col("reviewer_id").alias("x"), "target_id")
    # two large reviewers meet twice, once from each side; one of them counts
    other = p.join(many.withColumn("is_large", F.lit(True)), "reviewer_id", "left").select(F.col("reviewer_id").alias("y"), "target_id", "is_large")
    hot = big.join(other, "target_id").filter("x < y or (is_large is null and x > y)")
    hot = hot.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("shared"))
    s = s.unionByName(hot).filter(F.col("shared") >= least)
    return s.select("a", "b", "shared", (2 * F.col("shared") - 1).alias("weight"))


def _mask_pairs(batches: Iterator[pa.RecordBatch], least: int, chunk: int = 64) -> Iterator[pa.RecordBatch]:
    """(a, b, shared) of the reviewers of two blocks, or of one, whose masks share at least `least` bits; rarer targets in common are added."""
    import numpy as np
    import pyarrow.compute as pc

    t = pa.Table.from_batches(list(batches)).sort_by("reviewer_id").combine_chunks()
    lo, hi, blk, mask = (t.column(c).to_numpy() for c in ("lo", "hi", "blk", "mask"))
    names = t.column("reviewer_id").combine_chunks()
    names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
    one = lo[0] == hi[0]
    left = np.flatnonzero(blk == lo[0])
    right = left if one else np.flatnonzero(blk == hi[0])
    code = pc.list_flatten(t.column("rare")).combine_chunks().dictionary_encode()
    code = (code.chunk(0) if isinstance(code, pa.ChunkedArray) and code.num_chunks else code).indices.to_numpy() if len(code) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(mask)), pc.list_value_length(t.column("rare")).to_numpy())
    place = np.full(len(mask), -1)
    place[right] = np.arange(len(right))
    on_right = place[row] >= 0
    by = np.argsort(code[on_right], kind="stable")
    right_code, right_place = code[on_right][by], place[row[on_right]][by]
    for k in range(0, len(left), chunk):
        x = left[k : k + chunk]
        shared = np.bitwise_count(mask[x][:, None] & mask[right][None, :]).astype(np.int16)
        keep = shared >= least
        if one:
            keep &= x[:, None] < right[None, :]
        at = np.arange(np.searchsorted(row, x[0]), np.searchsorted(row, x[-1], side="right"))
        at = at[place[row[at]] < 0] if not one else at
        a, b = np.searchsorted(right_code, code[at]), np.searchsorted(right_code, code[at], side="right")
        n = b - a
        ix = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        np.add.at(shared, (np.repeat(np.searchsorted(x, row[at]), n), right_place[ix]), 1)
        i, j = np.nonzero(keep)
        if len(i):
            v, w = x[i], right[j]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.minimum(v, w))), names.take(pa.array(np.maximum(v, w))), pa.array(shared[i, j].astype(np.int64))], names=["a", "b", "shared"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that can be reached; labels fall along edges, halved by pointer jumps, until none changes."""
    e = edges.select(F.col(a).alias("v"), F.col(b).alias("u"))
    e = cut(e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct(), "cc-edges")
    label = cut(e.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("l")), "cc")
    while True:
        near = e.join(label.select(F.col("v").alias("u"), "l"), "u").groupBy("v").agg(F.min("l").alias("m"))
        step = label.join(near, "v").select("v", F.least("l", "m").alias("n"), "l")
        jump = step.select(F.col("v").alias("n"), F.col("n").alias("j"))
        new = cut(step.join(jump, "n", "left").select("v", F.least("n", F.coalesce("j", "n")).alias("l"), (F.least("n", F.coalesce("j", "n")) != F.col("l")).alias("changed")), "cc")
        label = new.select("v", "l")
        if new.filter("changed").isEmpty():
            return label.select(F.col("v").alias("node"), F.col("l").alias("component"))
