"""Experts on text, time and graph, their trainers, the gate that weighs them, and the diagnostics of a fusion.

Training reads at most max_rows labelled rows (those with the smallest hashes of their ids, documented and bounded);
scoring covers every row, in Arrow batches against broadcast weights. Networks are NumPy layers: rows times weights, ReLU
between, trained by Adam on the weighted logistic loss, the weights of the best validation average precision kept.

Defined results: rows without a label never train; an empty mask has loss 0; a single class trains to its prior; a missing
vector is scored as missing (null); experts that are all missing leave a row `insufficient_data`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.fusion import calibrate, class_weight, fit_platt, logit, masked_softmax, mean_available, sigmoid

#: The experts in their order.
EXPERTS = ("text", "graph", "time")


# -- NumPy layers ----------------------------------------------------------------------------------------------------


def init_layers(sizes: list[int], seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {}
    for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
        out[f"w{i}"] = rng.normal(0, math.sqrt(2 / a), (a, b))
        out[f"b{i}"] = np.zeros(b)
    return out


def forward(weights: dict[str, np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """The values of all layers; the last has no ReLU."""
    n = sum(k[0] == "w" for k in weights)
    values = [x]
    for i in range(n):
        z = values[-1] @ weights[f"w{i}"] + weights[f"b{i}"]
        values.append(np.maximum(z, 0) if i < n - 1 else z)
    return values


def masked_loss(logits: np.ndarray, labels: np.ndarray, mask: np.ndarray, pos_weight: float) -> tuple[float, np.ndarray]:
    """Mean weighted logistic loss over the mask, and its gradient; 0 where the mask is empty."""
    n = int(mask.sum())
    if not n:
        return 0.0, np.zeros_like(logits)
    w = np.where(labels > 0, pos_weight, 1.0) * mask
    loss = np.maximum(logits, 0) - logits * labels + np.log1p(np.exp(-np.abs(logits)))
    return float((w * loss).sum() / n), w * (1 / (1 + np.exp(-logits.clip(-60, 60))) - labels) / n


def average_precision(labels: np.ndarray, scores: np.ndarray) -> float | None:
    """Step-wise over distinct scores; None with a single class."""
    if not 0 < labels.sum() < len(labels):
        return None
    order = np.argsort(-scores, kind="stable")
    y, s = labels[order], scores[order]
    last = np.append(s[1:] != s[:-1], True)
    tp, n = np.cumsum(y)[last], (np.arange(len(y)) + 1)[last]
    return float((np.diff(tp, prepend=0) * tp / n).sum() / y.sum())


def train_network(x: np.ndarray, y: np.ndarray, val_x: np.ndarray, val_y: np.ndarray, hidden: tuple[int, ...] = (128, 64), epochs: int = 60, patience: int = 10, rate: float = 1e-3, decay: float = 1e-4, clip: float = 5.0, batch: int = 256, cap: float = 100.0, seed: int = 42) -> tuple[dict[str, np.ndarray], list[tuple[int, float, float | None]]]:
    """Weights of the best validation average precision (of the last epoch where there is none), and (epoch, loss, average precision) by epoch."""
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    pos_weight = min(neg / pos, cap) if pos and neg else 1.0
    weights = init_layers([x.shape[1], *hidden, 1], seed)
    m = {k: np.zeros_like(v) for k, v in weights.items()}
    v2 = {k: np.zeros_like(v) for k, v in weights.items()}
    rng, best, held, log, step = np.random.default_rng(seed), -1.0, weights, [], 0
    n_layers, since = len(hidden) + 1, 0
    for epoch in range(epochs):
        order, total = rng.permutation(len(x)), 0.0
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            values = forward(weights, x[rows])
            loss, g = masked_loss(values[-1][:, 0], y[rows], np.ones(len(rows)), pos_weight)
            total += loss * len(rows)
            grads, g = {}, g[:, None]
            for i in range(n_layers - 1, -1, -1):
                grads[f"w{i}"], grads[f"b{i}"] = values[i].T @ g, g.sum(0)
                g = (g @ weights[f"w{i}"].T) * (values[i] > 0)
            norm = math.sqrt(sum(float((z * z).sum()) for z in grads.values()))
            shrink, step = min(1.0, clip / (norm + 1e-12)), step + 1
            for k, z in grads.items():
                z = z * shrink
                m[k], v2[k] = 0.9 * m[k] + 0.1 * z, 0.999 * v2[k] + 0.001 * z * z
                weights[k] = weights[k] * (1 - rate * decay) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        ap = average_precision(val_y, forward(weights, val_x)[-1][:, 0]) if len(val_x) else None
        log.append((epoch, total / max(len(x), 1), ap))
        if ap is None:
            held = {k: z.copy() for k, z in weights.items()}
        elif ap > best:
            best, since, held = ap, 0, {k: z.copy() for k, z in weights.items()}
        elif (since := since + 1) >= patience:
            break
    return held, log


# -- training and scoring over tables ----------------------------------------------------------------------------------


def labelled_sample(rows: DataFrame, vector: str, max_rows: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of at most max_rows labelled rows, in hash order."""
    got = rows.filter(F.col("label").isin(0, 1) & F.col(vector).isNotNull()).select(F.col(vector).alias("v"), "label", F.xxhash64("review_id").alias("h"), "review_id").orderBy("h", "review_id").limit(max_rows).select("v", "label").toArrow()
    if not got.num_rows:
        return np.empty((0, 1)), np.empty(0)
    return np.array(got["v"].to_pylist(), dtype=np.float64), got["label"].to_numpy().astype(np.float64)


def train_expert(train: DataFrame, validation: DataFrame, vector: str, max_rows: int = 50_000, **how) -> tuple[dict[str, np.ndarray], list]:
    """An expert on one vector column, from rows with review_id, label and the vector."""
    x, y = labelled_sample(train, vector, max_rows)
    if not len(x) or len(set(y.tolist())) < 2:
        raise ValueError("training needs labelled rows of both classes")
    vx, vy = labelled_sample(validation, vector, max_rows)
    return train_network(x, y, vx if len(vx) else np.empty((0, x.shape[1])), vy, **how)


def score_rows(rows: DataFrame, vector: str, weights: dict[str, np.ndarray], chunk: int = 1024) -> DataFrame:
    """(review_id, logit, h): the expert's logit and its last hidden layer for every row; null where the vector is missing."""
    held = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, chunk):
                part = b.slice(at, chunk)
                there = np.flatnonzero(part.column(1).is_valid().to_numpy(zero_copy_only=False))
                logits, hidden = [None] * part.num_rows, [None] * part.num_rows
                if len(there):
                    values = forward(held.value, np.array(part.column(1).take(pa.array(there)).to_pylist(), dtype=np.float64))
                    for i, z, h in zip(there.tolist(), values[-1][:, 0].tolist(), values[-2].tolist()):
                        logits[i], hidden[i] = z, h
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(logits, pa.float64()), pa.array(hidden, pa.list_(pa.float64()))], names=["review_id", "logit", "h"])

    return rows.select("review_id", F.col(vector).cast("array<double>")).mapInArrow(run, f"review_id {dict(rows.dtypes)['review_id']}, logit double, h array<double>")


def hashed_vectors(texts: DataFrame, width: int = 64) -> DataFrame:
    """(review_id, vector) of (review_id, text): the built-in encoder where no other is there. Words and pairs of neighbours
    fall into `width` signed slots by a hash; vectors have length one, blank texts are null."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    w = texts.select("review_id", words.alias("w"))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    terms = w.select("review_id", F.explode_outer(F.concat("w", pairs)).alias("t"))
    slot = terms.select("review_id", F.pmod(F.xxhash64("t"), F.lit(width)).cast("int").alias("s"), F.when(F.col("t").isNull(), 0.0).when(F.xxhash64(F.lit("sign"), "t") % 2 == 0, 1.0).otherwise(-1.0).alias("x"))
    sums = slot.groupBy("review_id", "s").agg(F.sum("x").alias("x")).groupBy("review_id").agg(F.map_from_entries(F.collect_list(F.struct("s", "x"))).alias("m"))
    v = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return sums.select("review_id", F.when(norm > 0, F.transform(v, lambda x: x / norm)).alias("vector"))


ENCODERS = {"hashed": hashed_vectors}


def encoder(name: str = "hashed") -> tuple[str, object]:
    """(name that is really used, encoder): the built-in one where the asked one isn't registered."""
    return (name, ENCODERS[name]) if name in ENCODERS else ("hashed", hashed_vectors)


def joined_text(title: Column, body: Column) -> Column:
    """"Title. Body", without the dot where one of them is blank."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.concat_ws(". ", blank(title), blank(body))


def propagated(edges: DataFrame, features: DataFrame, relations: tuple[str, ...], hops: int = 2) -> DataFrame:
    """(review_id, h): each node's vector beside the means of its neighbours', theirs and so on, by relation.

    Message passing without weights, once for all epochs; a network over these vectors stands in for a graph network.
    """
    from tidegraph.operators.graph import neighbour_mean
    from tidegraph.session import cut

    kind = features.select(F.size("h").alias("n")).limit(1).collect()
    zero = F.array(*(F.lit(0.0) for _ in range(kind[0].n))) if kind else F.array().cast("array<double>")
    out, step = features.select("review_id", "h"), features.select("review_id", "h")
    for _ in range(hops):
        m = neighbour_mean(edges, step, "review_id", "h")
        by = m.groupBy(F.col("dst").alias("review_id")).agg(*(F.first(F.when(F.col("relation") == r, F.col("mean")), ignorenulls=True).alias(f"m{i}") for i, r in enumerate(relations)))
        j = features.select("review_id").join(by, "review_id", "left").select("review_id", *(F.coalesce(f"m{i}", zero).alias(f"m{i}") for i in range(len(relations))))
        j = cut(j, "hop")
        out = out.join(j, "review_id").select("review_id", F.concat("h", *(F.col(f"m{i}") for i in range(len(relations)))).alias("h"))
        n = F.lit(float(len(relations)))
        total = F.col("m0")
        for i in range(1, len(relations)):
            total = F.zip_with(total, F.col(f"m{i}"), lambda a, b: a + b)
        step = j.select("review_id", F.transform(total, lambda v: v / n).alias("h"))
    return out


def prior_model(train: DataFrame) -> DataFrame:
    """One row: the share of positives among the labelled rows; null without any."""
    return train.filter(F.col("label").isin(0, 1)).agg(F.round(F.avg("label"), 6).alias("prior"), F.count("*").alias("n"))


def availability(rows: DataFrame) -> DataFrame:
    """(review_id, text, graph, time): which experts see a row (text_missing, in_degree, time_available)."""
    return rows.select("review_id", (~F.coalesce(F.col("text_missing"), F.lit(False))).alias("text"), (F.coalesce(F.col("in_degree"), F.lit(0)) > 0).alias("graph"), F.coalesce("time_available", F.lit(True)).alias("time"))


def single_score(logits: list[Column]) -> Column:
    """Mean of the sigmoids of several logits of one expert."""
    return sum(sigmoid(z) for z in logits) / len(logits)


# -- fusion ----------------------------------------------------------------------------------------------------------


def simplex(step: int = 10) -> list[tuple[float, ...]]:
    """All weights of three experts in steps of 1/step: 66 points for 10."""
    return [(a / step, b / step, (step - a - b) / step) for a in range(step + 1) for b in range(step + 1 - a)]


def grid_average_precision(rows: DataFrame, experts: list[str], step: int = 10) -> DataFrame:
    """(wa, wb, wc, average_precision) of the weighted mean of the available experts, for each point of the simplex.

    Scores are rounded to six digits; each grid point's curve is a running total over its distinct scores.
    """
    from pyspark.sql import Window

    points = rows.sparkSession.createDataFrame(simplex(step), "wa double, wb double, wc double")
    judged = rows.filter(F.col("label").isin(0, 1))
    w = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(p, ("wa", "wb", "wc")))) for p in simplex(step)))
    x = judged.select(*experts, "label", F.explode(w).alias("w"))
    held = sum(F.when(F.col(e).isNotNull(), F.col(f"w.{n}")).otherwise(0.0) for e, n in zip(experts, ("wa", "wb", "wc")))
    score = F.round(F.try_divide(sum(F.coalesce(F.col(e), F.lit(0.0)) * F.col(f"w.{n}") for e, n in zip(experts, ("wa", "wb", "wc"))), held), 6)
    g = x.select("w.*", score.alias("s"), "label").filter("s is not null").groupBy("wa", "wb", "wc", "s").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    o = Window.partitionBy("wa", "wb", "wc").orderBy(F.desc("s"))
    g = g.withColumn("tp", F.sum("p").over(o)).withColumn("m", F.sum("n").over(o))
    a = g.groupBy("wa", "wb", "wc").agg(F.round(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("m")), F.sum("p")), 6).alias("average_precision"))
    return points.join(a, ["wa", "wb", "wc"], "left")


def global_weights(rows: DataFrame, experts: list[str], step: int = 10) -> tuple[float, ...]:
    """The grid point of greatest average precision; the first among equals."""
    g = grid_average_precision(rows, experts, step)
    best = g.orderBy(F.desc_nulls_last("average_precision"), "wa", "wb").first()
    return (best.wa, best.wb, best.wc)


def gate_inputs(rows: DataFrame, experts: list[str], context: str = "context") -> Column:
    """One vector: each expert's logit (0 if missing), its availability, and the context."""
    parts = [F.coalesce(logit(F.col(e)), F.lit(0.0)) for e in experts] + [F.col(e).isNotNull().cast("double") for e in experts]
    return F.concat(F.array(*parts), F.coalesce(F.col(context).cast("array<double>"), F.array().cast("array<double>")))


def train_gate(rows: DataFrame, experts: list[str], max_rows: int = 20_000, hidden: int = 64, epochs: int = 200, rate: float = 0.01, cap: float = 100.0, seed: int = 42) -> dict[str, np.ndarray]:
    """A network that gives each row its own weights over its available experts; expert outputs stay as they are.

    Trained on labelled rows with any expert: the logistic loss of the fused probability, by full-batch gradient steps.
    """
    some = rows.filter(mean_available(experts).isNotNull()).withColumn("_g", F.concat(gate_inputs(rows, experts), F.array(*(F.coalesce(F.col(e), F.lit(0.0)).cast("double") for e in experts))))
    x, y = labelled_sample(some, "_g", max_rows)
    k = len(experts)
    p, x = x[:, -k:], x[:, :-k]
    there = x[:, k : 2 * k]
    w = init_layers([x.shape[1], hidden, k], seed)
    pos, neg = (y == 1).sum(), (y == 0).sum()
    weight = np.where(y > 0, min(neg / pos, cap) if pos and neg else 1.0, 1.0)[:, None]
    m, v, at = {n: 0.0 for n in w}, {n: 0.0 for n in w}, 0
    for at in range(1, epochs + 1):
        h, z = forward(w, x)[1:]
        e = np.exp(z - z.max(1, keepdims=True)) * there
        a = e / np.maximum(e.sum(1, keepdims=True), 1e-12)
        fused = (a * p).sum(1, keepdims=True).clip(1e-6, 1 - 1e-6)
        g = weight * (fused - y[:, None]) / (fused * (1 - fused)) / len(y)
        dz = a * (p - fused) * g
        dh = (dz @ w["w1"].T) * (h > 0)
        for n, d in (("w1", h.T @ dz), ("b1", dz.sum(0)), ("w0", x.T @ dh), ("b0", dh.sum(0))):
            m[n], v[n] = 0.9 * m[n] + 0.1 * d, 0.999 * v[n] + 0.001 * d * d
            w[n] = w[n] - rate * (m[n] / (1 - 0.9**at)) / (np.sqrt(v[n] / (1 - 0.999**at)) + 1e-8)
    return w


def adaptive_fusion(rows: DataFrame, experts: list[str], weights: dict[str, np.ndarray]) -> DataFrame:
    """rows with w_<expert>, fused and insufficient_data: softmax of the gate's outputs over the available experts."""
    g = score_gate(rows.withColumn("_g", gate_inputs(rows, experts)), weights, len(experts))
    z = [F.col("_z")[i] for i in range(len(experts))]
    g = g.select("*", *(c.alias(f"_z{i}") for i, c in enumerate(z)))
    shares = masked_softmax([f"_z{i}" for i in range(len(experts))], [F.col(e).isNotNull() for e in experts])
    g = g.select(*rows.columns, *(s.alias(f"w_{e}") for s, e in zip(shares, experts)))
    fused = sum(F.coalesce(F.col(f"w_{e}") * F.col(e), F.lit(0.0)) for e in experts)
    none = F.col(f"w_{experts[0]}").isNull()
    return g.withColumn("fused", F.when(~none, fused)).withColumn("insufficient_data", none)


def score_gate(rows: DataFrame, weights: dict[str, np.ndarray], k: int) -> DataFrame:
    """rows with _z, the gate's outputs from the vector _g."""
    held = rows.sparkSession.sparkContext.broadcast(weights)
    ddl = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", _z array<double>"
    at = rows.columns.index("_g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = forward(held.value, np.array(b.column(at).to_pylist(), dtype=np.float64).reshape(b.num_rows, -1))[-1] if b.num_rows else np.empty((0, k))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(z), pa.list_(pa.float64()))], names=[*b.schema.names, "_z"])

    return rows.mapInArrow(run, ddl)


def gate_summary(fused: DataFrame, experts: list[str]) -> DataFrame:
    """(expert, mean_weight, sd_weight, max_weight) over the rows that have weights; NaN counts as missing."""
    rows = F.array(*(F.struct(F.lit(e).alias("expert"), F.col(f"w_{e}").alias("w")) for e in experts))
    x = fused.select(F.explode(rows).alias("x")).select("x.*").filter(F.col("w").isNotNull() & ~F.isnan("w"))
    return x.groupBy("expert").agg(F.round(F.avg("w"), 6).alias("mean_weight"), F.round(F.stddev_pop("w"), 6).alias("sd_weight"), F.round(F.max("w"), 6).alias("max_weight"))


def frozen_threshold(validation: DataFrame, score: str = "score") -> float:
    """The lowest threshold of best F1 on validation rows; 0.5 with a single class."""
    from tidegraph.operators.evaluation import ranking_summary

    got = ranking_summary(validation.withColumn("score", F.col(score))).first()
    return 0.5 if got.best_threshold is None else float(got.best_threshold)


def stress(rows: DataFrame, experts: list[str], drop: str, share: float, fuse, seed: int = 77) -> DataFrame:
    """rows with `fused` after one expert is taken from a share of them, drawn by md5; fuse gives the fused column of the experts."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(drop), F.col("review_id").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return rows.withColumn(drop, F.when(u >= share, F.col(drop))).withColumn("fused", fuse(experts))


def rank_diagnostics(rows: DataFrame, experts: list[str]) -> DataFrame:
    """(a, b, n, spearman, disagreement): rank correlation of each pair of experts over rows that both see, and the share of rows on which they fall on different sides of 0.5."""
    from tidegraph.operators.records import percentile_ranks

    out = None
    for i, a in enumerate(experts):
        for b in experts[i + 1 :]:
            x = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
            r = percentile_ranks(percentile_ranks(x, a).withColumnRenamed("rank_share", "ra"), b).withColumnRenamed("rank_share", "rb")
            one = r.agg(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 5).alias("spearman"), F.round(F.avg(((F.col(a) >= 0.5) != (F.col(b) >= 0.5)).cast("double")), 6).alias("disagreement"))
            out = one if out is None else out.unionByName(one)
    return out


def row_extremes(rows: DataFrame, experts: list[str]) -> DataFrame:
    """(review_id, row_max, row_spread): the highest expert of each row and its distance to the lowest; nulls are passed over."""
    top, low = F.greatest(*experts), F.least(*experts)
    return rows.select("review_id", top.alias("row_max"), F.round(top - low, 6).alias("row_spread"))


def calibrated(train: DataFrame, rows: DataFrame, score: str = "score", least_positive: int = 3) -> DataFrame:
    """rows with `calibrated`; with fewer than least_positive positives the score passes through."""
    n = class_weight(train).first()
    a, b = fit_platt(train, score) if n.n_positive >= least_positive and n.n_negative else (1.0, 0.0)
    return calibrate(rows, a, b, score)

