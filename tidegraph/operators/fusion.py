"""Fusing expert probabilities under availability, calibration, class weights and simple baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.session import cut


def mean_available(experts: list[str]) -> Column:
    """Mean of the available (non-null) probabilities; null if none is available."""
    n = sum(F.when(F.col(e).isNotNull(), 1).otherwise(0) for e in experts)
    return F.try_divide(sum(F.coalesce(F.col(e), F.lit(0.0)) for e in experts), n)


def masked_softmax(logits: list[str], available: list[Column]) -> list[Column]:
    """Softmax over the available logits; null for all if none is available."""
    top = F.greatest(*(F.when(a, F.col(x)) for x, a in zip(logits, available)), F.lit(None).cast("double"))
    parts = [F.when(a, F.exp(F.col(x) - top)).otherwise(0.0) for x, a in zip(logits, available)]
    return [F.try_divide(p, sum(parts)) for p in parts]


def weighted_available(experts: list[str], weights: list[float]) -> Column:
    """Fixed weights renormalised over the available experts."""
    w = sum(F.when(F.col(e).isNotNull(), x).otherwise(0.0) for e, x in zip(experts, weights))
    return F.try_divide(sum(F.coalesce(F.col(e) * x, F.lit(0.0)) for e, x in zip(experts, weights)), w)


def logit(p: Column, eps: float = 1e-6) -> Column:
    """Log-odds of a probability kept eps away from 0 and 1; null stays null."""
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.when(p.isNotNull(), F.log(q / (1 - q)))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def class_weight(rows: DataFrame, label: str = "label", cap: float = 100.0) -> DataFrame:
    """One row: positives, negatives, and negatives per positive up to the cap (1 if a class is empty)."""
    p, n = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return rows.agg(p.alias("n_positive"), n.alias("n_negative"), F.round(F.when((p > 0) & (n > 0), F.least(n / p, F.lit(cap))).otherwise(1.0), 6).alias("pos_weight"))


def fit_platt(rows: DataFrame, score: str = "score", label: str = "label", rounds: int = 25) -> tuple[float, float]:
    """Slope and intercept of the calibration sigmoid by Newton steps, each one an aggregate; (1, 0) with a single class."""
    x = rows.filter(F.col(score).isNotNull() & F.col(label).isin(0, 1)).select(F.least(F.greatest(logit(F.col(score)), F.lit(-30.0)), F.lit(30.0)).alias("z"), F.col(label).cast("double").alias("y"))
    grouped = x.groupBy("z").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    t = grouped.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).first()
    if not t.n or t.p in (0, t.n):
        return 1.0, 0.0
    a, b = 1.0, 0.0
    for _ in range(rounds):
        q = sigmoid(F.lit(a) * F.col("z") + F.lit(b))
        r, w = F.col("p") - F.col("n") * q, F.col("n") * q * (1 - q)
        g = grouped.agg(F.sum(r * F.col("z")).alias("ga"), F.sum(r).alias("gb"), F.sum(w * F.col("z") ** 2).alias("haa"), F.sum(w * F.col("z")).alias("hab"), F.sum(w).alias("hbb")).first()
        ridge = 1e-6
        det = (g.haa + ridge) * (g.hbb + ridge) - g.hab**2
        da, db = ((g.hbb + ridge) * g.ga - g.hab * g.gb) / det, ((g.haa + ridge) * g.gb - g.hab * g.ga) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def calibrate(rows: DataFrame, a: float, b: float, score: str = "score") -> DataFrame:
    return rows.withColumn("calibrated", sigmoid(F.lit(a) * logit(F.col(score)) + F.lit(b)))


def train_logistic(rows: DataFrame, features: list[str], label: str = "label", c: float = 1.0):
    """Standardised, class-weighted logistic regression on rows with a known label."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    w = class_weight(rows, label).first()
    known = rows.filter(F.col(label).isin(0, 1)).withColumn("_w", F.when(F.col(label) == 1, w.pos_weight).otherwise(1.0))
    total = w.n_positive * w.pos_weight + w.n_negative
    steps = [VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol=label, weightCol="_w", regParam=1 / (c * total), maxIter=200)]
    return Pipeline(stages=steps).fit(known)


def tfidf(docs: DataFrame, id_col: str, text_col: str, min_df: int = 2) -> DataFrame:
    """(id, term, weight); min_df is 1 below 50 documents. Lower-case words and pairs of neighbours, (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), vectors of length one."""
    words = F.regexp_extract_all(F.lower(text_col), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    w = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), words.alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    tf = w.select("id", F.explode(F.concat("w", pairs)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    tf, n = cut(tf, "tf"), docs.count()
    min_df = min_df if n >= 50 else 1
    df = tf.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)
    x = tf.join(df, "term").select("id", "term", ((1 + F.log("tf")) * (F.log((1 + n) / (1 + F.col("df"))) + 1)).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id")))
    return x.select("id", "term", (F.col("x") / norm).alias("weight"))


def reduced(weights: DataFrame, most: int = 128, terms: int = 4096) -> DataFrame:
    """(id, vector): tf-idf vectors of (id, term, weight) in at most `most` dimensions, of length one.

    Singular vectors of the `terms` heaviest terms (a documented bound), from their Gram matrix; signs are fixed so that
    each direction's largest entry is positive. Texts without any of these terms have no row.
    """
    import numpy as np

    top = weights.groupBy("term").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).orderBy(F.desc("s"), "term").limit(terms).select("term").toArrow()["term"].to_pylist()
    place = weights.sparkSession.createDataFrame([(t, i) for i, t in enumerate(top)], "term string, i int")
    x = cut(weights.join(F.broadcast(place), "term").select("id", "i", "weight"), "kept")
    gram = x.alias("a").join(x.alias("b"), "id").groupBy(F.col("a.i").alias("r"), F.col("b.i").alias("c")).agg(F.sum(F.col("a.weight") * F.col("b.weight")).alias("v")).toArrow()
    g = np.zeros((len(top), len(top)))
    g[gram["r"].to_numpy(), gram["c"].to_numpy()] = gram["v"].to_numpy()
    values, vectors = np.linalg.eigh(g)
    v = vectors[:, np.argsort(-values)[:most]]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    rows = weights.sparkSession.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(v)], "i int, v array<double>")
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    w = x.join(F.broadcast(rows), "i").select("id", array_to_vector(F.transform("v", lambda z: z * F.col("weight"))).alias("x"))
    s = w.groupBy("id").agg(vector_to_array(Summarizer.sum(F.col("x"))).alias("s"))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, z: a + z * z))
    return s.select("id", F.transform("s", lambda z: F.when(norm > 0, z / norm).otherwise(0.0)).alias("vector"))
