"""Abusive, hateful or sexual content by maximum-scoring segments.

Tokens (spelling tricks undone) and pairs of neighbouring tokens get log-odds of abusive against other text, with a
Dirichlet prior in the proportions of the whole corpus. Labels name documents, not passages: the fit alternates between
finding the best passage of each abusive document and counting only these passages as abusive. A document's passages
are all its maximal scoring segments, found in one linear scan. The best segment of ordinary text grows like the
logarithm of its length (an extreme-value law); its two parameters turn a segment's score into a normalised one, whose
exponential is the number of such segments expected by chance. A document is judged by all of its significant passages
(SIGNIFICANT): for the r best the law of the sum of their normalised scores gives a chance, and the least chance over all
r, less for the choice, is the document's score (minus its decimal logarithm). Segments that are common by chance don't
add up: in real text they come together more often than the law allows.

The fit reads a bounded sample of labelled rows (max_labelled rows, max_tokens tokens); corpus counts and scores cover
every document. Texts are read into tokens once; counts, fit and scores work on the written table of slots.

Defined results: null, empty and wordless texts score 0 and aren't flagged; labels that disagree are decided by
majority, ties and null labels are left out; with no labels of one class every document scores 0; repeated ids are
scored for each row; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.session import cut

#: Slots for tokens and pairs; they bound the model and all counts, whatever the vocabulary.
SLOTS = 1 << 18
#: Characters that stand for letters, and Cyrillic or Greek letters that look like Latin ones.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})
ALIKE = str.maketrans("асеорхуіѕјԁһαεοικνρτυ", "aceopxyisjdhaeoiknptu")

_CHUNK = re.compile(r"\S+")
_EDGE = re.compile(r"^[^\w$@]+|[^\w$]+$")
_INSIDE = re.compile(r"[^\W_]+")
_SPREAD = re.compile(r"(?<![^\W_])[^\W\d_]([ .\-_*·])[^\W\d_](?:\1[^\W\d_]){2,}(?![^\W_]|\*)")
_THRICE = re.compile(r"(.)\1{2,}")
_CYRILLIC = re.compile("[Ͱ-ӿԀ-ԯ]")
_IGNORED = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁯︀-️﻿]")


def _join(m: re.Match) -> str:
    whole = m.group()[::2]
    return f"{whole} {whole[1:]}" if m.group(1) == " " and whole[0] in "ai" else whole


def tokens(text: str) -> list[str]:
    """Lower-case tokens with spelling tricks undone: spaced or dotted letters, digits and signs for letters, look-alikes; a masked word becomes its visible ends.

    Letters are joined over one and the same separator, so a wider gap ends a word. Where the first letter of a spaced
    run may be a word of its own (a, i), the run without it follows as a further token.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _IGNORED.sub("", text))
        if _CYRILLIC.search(text):
            text = text.translate(ALIKE)
    text = _SPREAD.sub(_join, text.lower())
    out: list[str] = []
    for chunk in _CHUNK.findall(text):
        if chunk.isalpha():
            out.append(chunk)
            continue
        core = _EDGE.sub("", chunk)
        if not core:
            continue
        if core.isdigit():
            out.append("0")
        elif core.isalpha():
            out.append(core)
        elif "*" in core and re.fullmatch(r"[^\W_]+\*+[^\W_]*", core):
            out += ["<masked>", re.sub(r"\*+", "*", core)]
        elif (plain := core.translate(LEET)).isalpha() and any(x.isalpha() for x in core):
            out.append(plain)
        elif re.fullmatch(r"[^\W_]+(?:[.\-_*·][^\W_]+)+", core) and max(map(len, _INSIDE.findall(core))) == 1:
            out.append("".join(_INSIDE.findall(core)))
        else:
            out += ["0" if x.isdigit() else x.translate(LEET) for x in _INSIDE.findall(core)]
    return [_THRICE.sub(r"\1", t) for t in out]


class Slots:
    """Slots of tokens and pairs, remembered up to a fixed number."""

    def __init__(self, most: int = 300_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        ts = tokens(text) if text else []
        if len(self.known) > self.most:
            self.known.clear()
        get = self.known.get
        one, two = [], []
        before = "<s>"
        for t in ts:
            for key, to in ((t, one), (before + " " + t, two)):
                s = get(key)
                if s is None:
                    s = self.known[key] = xxhash.xxh3_64_intdigest(key) % SLOTS
                to.append(s)
            before = t
        return np.array(one, np.int32), np.array(two, np.int32)


def slot_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., n, one, two): the slots of each document's tokens and pairs, written once; no shuffle."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields) if keep else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            got = [slots.of(t) for t in batch.column(1).to_pylist()]
            cols = [pa.array([len(x) for x, _ in got], pa.int32()), *(pa.array([x[j].tobytes() for x in got], pa.binary()) for j in (0, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(2 + j) for j in range(len(keep))), *cols], names=["id", *keep, "n", "one", "two"])

    return cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"), *keep).mapInArrow(run, "id bigint, " + (kept + ", " if kept else "") + "n int, one binary, two binary"), "slots")


def _ints(column: pa.Array) -> np.ndarray:
    """All values of a binary column of int32, one row after the other."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "u1")[offsets[0] : offsets[-1]].view(np.int32) if len(column) and offsets[-1] > offsets[0] else np.empty(0, np.int32)


def corpus_counts(table: DataFrame) -> np.ndarray:
    """Tokens (row 0) and pairs (row 1) of all documents by slot, added up per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SLOTS), np.int64)
        for batch in batches:
            for r in (0, 1):
                counts[r] += np.bincount(_ints(batch.column(r)), minlength=SLOTS)
        flat = counts.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at])], names=["s", "n"])

    got = table.select("one", "two").mapInArrow(run, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(2 * SLOTS, np.int64)
    flat[got["s"].to_numpy()] = got["n"].to_numpy()
    return flat.reshape(2, SLOTS)


def best_segment(s: np.ndarray) -> tuple[float, int, int]:
    """Score and bounds of the best segment; (0, 0, 0) if no token scores above 0."""
    if not len(s) or s.max() <= 0:
        return 0.0, 0, 0
    c = np.concatenate(([0.0], np.cumsum(s)))
    low = np.minimum.accumulate(c)
    e = int(np.argmax(c - low))
    return float(c[e] - low[e]), int(np.argmin(c[: e + 1])), e


def maximal_segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time.

    One scan over the positive scores with a stack of candidates. Each keeps the place of the last candidate below it
    with a smaller sum before its start; the search for such a one follows these links and never looks twice at what
    they pass over.
    """
    sums = np.concatenate(([0.0], np.cumsum(s)))
    at = np.flatnonzero(np.asarray(s) > 0).tolist()
    before, after = sums[at].tolist(), sums[[i + 1 for i in at]].tolist()
    start: list[int] = []
    end: list[int] = []
    low: list[float] = []
    high: list[float] = []
    link: list[int] = []
    for i, left, right in zip(at, before, after):
        first, j = i, len(start) - 1
        while j >= 0 and low[j] >= left:
            j = link[j]
        while j >= 0 and high[j] < right:  # joined with what starts lower and ends lower
            first, left, next_ = start[j], low[j], link[j]
            for x in (start, end, low, high, link):
                del x[j:]
            j = next_
        start.append(first), end.append(i + 1), low.append(left), high.append(right), link.append(j)
    return [(a, b, h - v) for a, b, v, h in zip(start, end, low, high)]


class Model:
    """Scores of slots, and the extreme-value parameters and limit of significance."""

    def __init__(self, scores: np.ndarray, lam: float, k: float, limit: float) -> None:
        self.scores, self.lam, self.k, self.limit = scores, lam, k, limit

    def token_scores(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.scores[0][one] + self.scores[1][two] - DRIFT

    def normal(self, score: float, n: int) -> float:
        """The score less what chance gives in n tokens; its exponential is the number of such segments expected, inverted."""
        return self.lam * score - math.log(self.k * max(n, 1))

    def evidence(self, score: float, n: int) -> float:
        """Minus log10 of the segments of that score expected by chance in n tokens; at least 0."""
        return max(0.0, self.normal(score, n) / math.log(10)) if score > 0 else 0.0

    def judge(self, s: np.ndarray) -> tuple[float, int, int, int]:
        """Score of a document from all of its significant passages; the bounds of the best one; the number of such passages.

        The sum t of the r best normalised scores has by chance about exp(-t) * t^(r-1) / (r! (r-1)!) (law of the sum of
        extreme values); looking at r instead of r - 1 costs a factor of 2.
        """
        top, a, b = best_segment(s)
        best = self.evidence(top, len(s))
        if best < SIGNIFICANT:
            return best, a, b, 0
        scores = sorted((x for *_, v in maximal_segments(s) if (x := self.normal(v, len(s))) >= SIGNIFICANT * math.log(10)), reverse=True)
        t = scores[0] if scores else 0.0
        for r, x in enumerate(scores[1:], 2):
            t += x
            chance = t - (r - 1) * math.log(max(t, 1.0)) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2)
            best = max(best, chance / math.log(10))
        return best, a, b, len(scores)


#: A passage is significant if chance gives less than one like it in so many documents (decimal logarithm).
SIGNIFICANT = 8.0
#: Subtracted from each token, so that ordinary text scores below 0 and a segment ends with the passage.
DRIFT = 1.0
#: Weight of the prior in tokens, and the bounds of one slot's log-odds.
PRIOR, LOW, HIGH = 400.0, -2.5, 4.0
#: Standard errors by which log-odds are drawn towards 0; passages below this share of the median are taken for wrong labels.
DOUBT, WEAK = 1.0, 0.4
#: The limit is the lowest whose F1 is within this of the best.
SLACK = 0.005


def _log_odds(yes: np.ndarray, no: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    out = np.zeros((2, SLOTS))
    for r in (0, 1):
        prior = PRIOR * (corpus[r] + 0.01) / (corpus[r].sum() + 0.01 * SLOTS)
        odds = np.log((yes[r] + prior) / (yes[r].sum() + PRIOR)) - np.log((no[r] + prior) / (no[r].sum() + PRIOR))
        doubt = np.sqrt(1 / (yes[r] + prior + 0.5) + 1 / (no[r] + prior + 0.5))
        out[r] = np.sign(odds) * np.maximum(np.abs(odds) - DOUBT * doubt, 0)  # what few occurrences show counts less
    out[1] /= 2  # a pair repeats part of what its tokens say
    return out.clip(LOW, HIGH)


def _count(docs: list, spans: list | None) -> np.ndarray:
    y = np.zeros((2, SLOTS))
    for i, (one, two) in enumerate(docs):
        a, b = (0, len(one)) if spans is None else spans[i]
        np.add.at(y[0], one[a:b], 1)
        np.add.at(y[1], two[a:b], 1)
    return y


def _learn(yes: list, no: list, corpus: np.ndarray, rounds: int) -> np.ndarray:
    no_counts, yes_counts = _count(no, None), _count(yes, None)
    scores = _log_odds(yes_counts, no_counts, corpus)
    for _ in range(rounds):
        spans, floor = [], []
        for one, two in yes:
            s, a, b = best_segment(scores[0][one] + scores[1][two] - DRIFT)
            spans.append((a, b))
            floor.append(s)
        weak = WEAK * float(np.median(floor))  # wrong labels have no passage
        spans = [(a, b) if s > weak else (0, 0) for (a, b), s in zip(spans, floor)]
        passages = _count(yes, spans)
        scores = _log_odds(passages, no_counts + yes_counts - passages, corpus)
    return scores


def _extreme(scores: np.ndarray, no: list) -> tuple[float, float]:
    """lambda and K of the best-segment law of ordinary text: lambda by the score distribution, K by maximum likelihood."""
    steps = np.concatenate([scores[0][o] + scores[1][t] - DRIFT for o, t in no if len(o)] or [np.array([-1.0])])
    low, high = 1e-3, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.exp(np.minimum(mid * steps, 50)).mean() < 1 else (low, mid)
    best = np.array([(best_segment(scores[0][o] + scores[1][t] - DRIFT)[0], len(o)) for o, t in no if len(o)] or [(0.0, 1)])
    return float(low), float(len(best) / (best[:, 1] * np.exp(-low * best[:, 0])).sum())


def fit(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", max_labelled: int = 20_000, max_tokens: int = 5_000_000, rounds: int = 4) -> Model:
    """The model from labelled documents of slot_table() (those with the smallest hashes, up to max_labelled rows and max_tokens tokens) and the counts of all documents.

    The limit of significance is the lowest with about the best F1 on documents that the scores in use were not learned from (two halves).
    """
    votes = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg("toxic").alias("v")).filter("v <> 0.5")
    some = cut(votes.join(table.select("id", "n").dropDuplicates(["id"]), "id").orderBy(F.xxhash64("id"), "id").limit(max_labelled), "votes")
    before = F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id"))  # over max_labelled rows
    some = some.withColumn("_sum", before).filter(F.col("_sum") <= max_tokens).select("id", "v")
    rows = table.select("id", "one", "two").join(F.broadcast(some), "id").toArrow().sort_by("id").to_pylist()
    corpus = corpus_counts(table)
    data = [((np.frombuffer(r["one"], np.int32), np.frombuffer(r["two"], np.int32)), r["v"] > 0.5) for r in rows]
    yes, no = [x for x, v in data if v], [x for x, v in data if not v]
    if not yes or not no:
        return Model(np.zeros((2, SLOTS), np.float32), 1.0, 1.0, math.inf)
    judged: list[tuple[float, bool]] = []
    for half in (0, 1):
        scores = _learn(yes[half::2] or yes, no[half::2] or no, corpus, rounds)
        m = Model(scores, *_extreme(scores, no[half::2] or no), 0.0)
        judged += [(m.judge(m.token_scores(*x))[0], v) for xs, v in ((yes[1 - half :: 2], True), (no[1 - half :: 2], False)) for x in xs]
    judged.sort(key=lambda x: -x[0])
    hits, curve = 0, [(0.0, 1.0)]
    for n, (e, v) in enumerate(judged, 1):
        hits += v
        after = judged[n][0] if n < len(judged) else 0.0
        if e > after:
            curve.append((2 * hits / (n + len(yes)), (e + after) / 2))
    best = max(curve)[0]
    limit = min(x for f1, x in curve if f1 >= best - SLACK)
    scores = _learn(yes, no, corpus, rounds)
    return Model(scores.astype(np.float32), *_extreme(scores, no), limit)


def score_documents(table: DataFrame, model: Model, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., score, n_tokens, n_passages, first_token, end_token, flagged) of every document of slot_table(); no shuffle.

    first_token and end_token bound the best passage of a flagged document.
    """
    held = table.sparkSession.sparkContext.broadcast(model)  # 2 * SLOTS floats
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*keep).schema.fields) if keep else ""
    ddl = "id bigint, " + (kept + ", " if kept else "") + "score double, n_tokens int, n_passages int, first_token int, end_token int, flagged boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            out = []
            sizes = batch.column(1).to_numpy()
            every = m.token_scores(_ints(batch.column(2)), _ints(batch.column(3)))
            ends = np.cumsum(sizes)
            for lo, hi in zip((ends - sizes).tolist(), ends.tolist()):
                e, a, b, passages = m.judge(every[lo:hi])
                flagged = e >= m.limit
                out.append((round(e, 6), hi - lo, passages, a if flagged else None, b if flagged else None, flagged))
            types = [pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            cols = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(4 + j) for j in range(len(keep))), *cols], names=["id", *keep, "score", "n_tokens", "n_passages", "first_token", "end_token", "flagged"])

    return table.select("id", "n", "one", "two", *keep).mapInArrow(run, ddl).withColumnRenamed("id", id_col)


def source_rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """(source, n_documents, n_flagged, rate, mean_score)."""
    g = scored.groupBy(source).agg(F.count("*").alias("n_documents"), F.count_if("flagged").alias("n_flagged"), F.round(F.avg("score"), 4).alias("mean_score"))
    return g.withColumn("rate", F.round(F.col("n_flagged") / F.col("n_documents"), 6))
