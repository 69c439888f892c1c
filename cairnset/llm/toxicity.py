"""Toxic passages as maximum-scoring segments of token log-odds.

Counts of word features (the word, and its first 6, 5 and 4 bytes) in toxic and other labelled rows give
log-odds with an informative Dirichlet prior; a token scores by its longest significant feature, less a
small cost, so that ordinary text drifts down. The linear-time scan for all maximal scoring segments
finds the passages. Extreme-value statistics of the best segment of rows labelled 0 (its location grows with the
logarithm of the length) make each segment's score a surprise; the document's surprises feed a logistic curve.

The model is trained on at most MAX_TRAINING labelled rows (those with the least hashes of doc_id), whose ids and labels
are broadcast, so that texts stay where they are. Counts, significance and the moments of the law are computed on the
executors; to the driver come the significant features and three numbers for each doc_id of the training.

Defined cases: a null, empty or wordless text has no segment and the score of its surprises 0; several labels
of one doc_id count as toxic if any is 1; without labels of both kinds every score is 0 and nothing is predicted.
Rows without doc_id are scored, and are not held out. Rows that share a doc_id are scored one by one. Only text goes to
Python, so other columns, whatever their names and types, stay as they are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, free, parts, tidy

MAX_TRAINING = 100_000
#: Counts that a task holds before it sends them on.
HELD = 200_000
PREFIXES = (6, 5, 4)
COST, PRIOR, LEAST_WEIGHT = 0.03, 10.0, 2.5
SEGMENT_SURPRISE, THRESHOLD = 3.0, 0.7
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)).lower()


def tokens(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, as UTF-8, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


def features(word: bytes) -> list[bytes]:
    """Longest first: the word, closed by a space, then its first bytes."""
    return [word + b" ", *(word[:n] for n in PREFIXES if len(word) >= n)]


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, t, o): in how many toxic and other rows (text, toxic) of the task, in several shares; feature b'' counts the rows."""
    found: tuple[Counter, Counter] = (Counter(), Counter())  # of other rows, of toxic ones

    def flush() -> Iterator[pa.RecordBatch]:
        keys = list(found[0].keys() | found[1].keys())
        for at in range(0, len(keys), 10_000):
            part = keys[at : at + 10_000]
            counts = [pa.array([c[k] for k in part], pa.int64()) for c in (found[1], found[0])]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), *counts], ["feature", "t", "o"])
        for c in found:
            c.clear()

    for batch in parts(batches, 0):
        for text, toxic in zip(batch.column(0), batch.column(1)):
            seen = set(tokens(text.as_py()))
            own = found[toxic.as_py()]
            own.update([w + b" " for w in seen])
            for n in PREFIXES:
                own.update({w[:n] for w in seen if len(w) >= n})
            own[b""] += 1
        if len(found[0]) + len(found[1]) > HELD:
            yield from flush()
    yield from flush()


def significant(counted: DataFrame, toxic: int, other: int) -> DataFrame:
    """(feature, odds) from (feature, t, o): features of toxic rows whose log-odds are significant.

    The prior follows both classes' common rate. Significance is by the likelihood ratio, which holds for counts of 0 too, at
    what chance alone hardly gives any of so many features.
    """
    t, o = F.col("t").cast("double"), F.col("o").cast("double")
    able = counted.where("octet_length(feature) > 0 and t > 1").where(t / toxic >= 1.5 * o / other)
    least_z = math.sqrt(2 * math.log(max(2, able.count())))
    rate = (t + o) / (toxic + other)
    a = PRIOR * rate * toxic / (toxic + other) + 0.01
    b = PRIOR * rate * other / (toxic + other) + 0.01
    half, tiny = F.lit(0.5), F.lit(1e-9)
    odds = F.log((t + a) / F.greatest(toxic + PRIOR - t - a, half)) - F.log((o + b) / F.greatest(other + PRIOR - o - b, half))
    g = sum(2 * n * F.log(F.greatest(n, tiny) / F.greatest(total * rate, tiny)) for n, total in ((t, toxic), (o, other)))
    return able.select("feature", odds.alias("odds"), F.sqrt(F.greatest(g, F.lit(0.0))).alias("z")).where(F.col("z") >= least_z).where(F.col("odds") >= LEAST_WEIGHT).select("feature", "odds")


def segments(scores: Iterable[tuple[int, float]], cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), disjoint, in order; linear time.

    scores: (position, score) of the positive scores, in order; every other position scores -cost.
    """
    open_: list[tuple] = []  # start, end, sum before, sum after, nearest earlier one with a smaller sum before
    gained = 0.0
    for at, score in scores:
        start, left = at, gained - cost * at
        gained += score + cost
        right = gained - cost * (at + 1)
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= left:
                j = open_[j][4]
            if j < 0 or open_[j][3] >= right:
                open_.append((start, at + 1, left, right, j))
                break
            start, left = open_[j][0], open_[j][2]
            del open_[j:]
    return [(s, e, right - left) for s, e, left, right, _ in open_]


class Surprise:
    """Extreme-value law of the best segment of ordinary text: location a + b ln(n), scale s, by moments."""

    def __init__(self, n: float, x: float, y: float, xx: float, xy: float, yy: float):
        """Sums over ordinary texts, of 1 and of x = ln(length) and y = the best segment's score."""
        mean_x, mean_y = x / max(n, 1), y / max(n, 1)
        var_x, cov, var_y = xx / max(n, 1) - mean_x**2, xy / max(n, 1) - mean_x * mean_y, yy / max(n, 1) - mean_y**2
        self.b = max(0.0, cov / max(var_x, 1e-9)) if n > 2 else 0.0
        spread = math.sqrt(max(0.0, var_y - 2 * self.b * cov + self.b**2 * var_x))
        self.scale = max(0.3, spread * math.sqrt(6) / math.pi)
        self.a = mean_y - self.b * mean_x - 0.5772156649 * self.scale

    def of(self, score: np.ndarray, length: np.ndarray) -> np.ndarray:
        """-ln P(the best of ordinary text of this length scores as high)."""
        y = (score - self.a - self.b * np.log(np.maximum(length, 1.0))) / self.scale
        p = -np.expm1(-np.exp(-np.clip(y, -30, 30)))
        return -np.log(np.maximum(p, 1e-300))


def summary(found: list[tuple[int, int, float]], n: int, law: Surprise) -> tuple[float, float, float]:
    """Of a document: surprise of its best segment, sum of the significant ones' surprises, tokens in them as a share."""
    if not found:
        return 0.0, 0.0, 0.0
    each = law.of(np.array([s for _, _, s in found]), np.full(len(found), n))
    sure = each >= SEGMENT_SURPRISE
    return float(each.max()), float(each[sure].sum()), sum(e - s for (s, e, _), ok in zip(found, sure) if ok) / n


def shape(x: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(x)), np.log1p(x[:, 0]), np.log1p(x[:, 1]), np.minimum(x[:, 0], 10) / 10], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method on a few columns."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, odds: dict[bytes, float]):
        self.odds, self.law, self.curve = odds, None, None
        self.known: dict[bytes, float] = {}
        self.heads = {(f[:-1] if f.endswith(b" ") else f)[: min(PREFIXES)] for f in odds}

    def weight(self, word: bytes) -> float:
        if (value := self.known.get(word)) is None:
            if len(self.known) >= 100_000:
                self.known.clear()
            self.known[word] = value = next((self.odds[f] for f in features(word) if f in self.odds), 0.0) - COST
        return value

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        ws, heads, n = tokens(text), self.heads, min(PREFIXES)
        scores = ((i, self.weight(ws[i])) for i in [i for i, w in enumerate(ws) if w[:n] in heads])
        return len(ws), segments(((i, x) for i, x in scores if x > 0), COST)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(shape(x) @ self.curve, -30, 30)))


    def judge(self, text: str | None) -> tuple[float, list[dict]]:
        """Score and significant passages (in tokens of letters)."""
        n, found = self.scan(text)
        each = self.law.of(np.array([s for _, _, s in found]), np.full(len(found), n)) if found else []
        score = float(self.scores(np.array([summary(found, n, self.law)]))[0])
        return score, [{"start": s, "end": e, "surprise": float(p)} for (s, e, _), p in zip(found, each) if p >= SEGMENT_SURPRISE]


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Model | None:
    """docs and labels with doc_id; rows with crc32(doc_id as text) mod 3 = 1 are held out."""
    scratch = scratch.inner("train")
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    training = scratch.save(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAINING), "training")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(training), "doc_id")
    counted = rows.select("text", "toxic").mapInArrow(count_features, "feature binary, t long, o long")
    counted = scratch.save(counted.groupBy("feature").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).where("t > 1 or octet_length(feature) = 0"), "features")
    sums = counted.where("octet_length(feature) = 0").first()
    if not sums or not sums.t or not sums.o:
        scratch.close()
        return None
    model = Model({bytes(r.feature): r.odds for r in significant(counted, sums.t, sums.o).orderBy("feature").toLocalIterator()})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 2):
            done = [model.scan(t.as_py()) for t in batch.column(2)]
            found = pa.array([[float(s) for _, _, s in f] for _, f in done], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in done], pa.int64()), found], ["doc_id", "toxic", "n", "found"])

    scanned = scratch.save(rows.select("doc_id", "toxic", "text").mapInArrow(scan, "doc_id long, toxic int, n long, found array<double>"), "scanned")
    x, y = F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")), F.coalesce(F.array_max("found"), F.lit(0.0))
    moments = scanned.where("toxic = 0").agg(*(F.coalesce(F.sum(v), F.lit(0.0)) for v in (F.lit(1.0), x, y, x * x, x * y, y * y))).first()
    model.law = Surprise(*moments)

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [[(0, 0, s) for s in f] for f in pdf.found]
            v = np.array([summary(f, n, model.law) for f, n in zip(found, pdf.n)]).reshape(-1, 3)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "toxic": pdf.toxic, "best": v[:, 0], "total": v[:, 1], "share": v[:, 2]})

    # of rows that share a doc_id the most surprising, so there are at most MAX_TRAINING
    per = scanned.mapInPandas(summaries, "doc_id long, toxic int, best double, total double, share double").groupBy("doc_id", "toxic").agg(F.max(F.struct("best", "total", "share")).alias("v"))
    per = per.orderBy("doc_id").select("toxic", "v.*").toPandas()
    model.curve = logistic(shape(per[["best", "total", "share"]].to_numpy()), per.toxic.to_numpy(float))
    scratch.close()
    return model


RATED = "struct<score: double, predicted: int, passages: array<struct<start: int, end: int, surprise: double>>>"


def rated(text: Column, model: Model | None) -> Column:
    """struct(score, predicted, passages) of a column of texts."""
    if model is None:
        return F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(None).cast("array<struct<start:int,end:int,surprise:double>>").alias("passages"))
    kinds = pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("passages", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("surprise", pa.float64())])))])

    @F.arrow_udf(RATED)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            done = [model.judge(t.as_py()) for t in part]
            yield pa.array([{"score": s, "predicted": int(s >= THRESHOLD), "passages": p} for s, p in done], kinds)
        tidy()

    return run(text.cast("string"))


def scored(docs: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    """docs' named columns with score, predicted and the significant passages (in tokens of letters)."""
    name = free("rated", columns)
    out = docs.select(*map(col, columns), rated(F.col("text"), model).alias(name))
    return out.select(*map(col, columns), *(F.col(name)[c].alias(c) for c in ("score", "predicted", "passages")))
