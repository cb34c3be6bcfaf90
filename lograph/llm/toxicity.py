"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, padded with a space on both sides and cut into all its runs of ``ORDERS`` characters. The
hash of a run picks one of ``BUCKETS`` features; a feature is present or not. The ratio of a feature is
``log((p + A) / (q + A))`` with ``p`` and ``q`` the shares of toxic and other labelled documents that have it,
counted over all labelled training rows by Spark. A logistic regression with an L2 penalty is then fitted on
features scaled by their ratios, on a sample of at most about ``FIT_ROWS`` training rows of each class (the bound
of the fit's memory), chosen by a hash of the id; sampled rows weigh as much as their class.
The score of a document is the fitted probability.

Cases: a null or empty text has the two spaces only and gets the score of what its (few) features say. Null labels
and null ids of labels do not train; a label repeated counts once, contradicting ones count as toxic. With no toxic or no other
training row the score is the smoothed share of toxic rows for all documents. Equal texts get equal
scores. Very long texts are read whole. Extra columns are kept by :func:`scored`, but for one named ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lograph.session import written

ORDERS = (3, 4, 5)
BITS = 18
BUCKETS = 1 << BITS
SMOOTH = 1.0
FIT_ROWS = 4_000
PENALTY = 1.0
STEPS = 40
#: Up to so many labels (16 bytes each) go to every executor; beyond, documents are shuffled to their labels.
SENT_LABELS = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def buckets(text: str) -> np.ndarray:
    """The features of a text, with repeats."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    found = []
    for order in ORDERS:
        if len(points) < order:
            continue
        n = len(points) - order + 1
        h = points[:n] + np.uint64(order)
        for j in range(1, order):
            h = h * MIX + points[j:j + n]
        h ^= h >> np.uint64(29)
        h *= MIX
        found.append((h >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


class Seen:
    """The distinct features of one text after another, over one scratch array."""

    def __init__(self) -> None:
        self.mark = np.zeros(BUCKETS, dtype=bool)

    def of(self, text: str | None) -> np.ndarray:
        self.mark[buckets(text or "")] = True
        found = np.flatnonzero(self.mark)
        self.mark[found] = False
        return found.astype(np.int32)


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how many toxic and other texts have each feature."""
    seen, counts = Seen(), np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        labels = batch.column("toxic").to_pylist()
        for label, text in zip(labels, batch.column("text")):
            counts[label][seen.of(text.as_py())] += 1
    there = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[1][there]), pa.array(counts[0][there])], names=["bucket", "p", "q"])


def list_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = Seen()
    for batch in batches:
        found = [seen.of(text.as_py()) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), batch.column("weight"), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "weight", "found"],
        )


def fit_logistic(indices: np.ndarray, starts: np.ndarray, labels: np.ndarray, weights: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by feature and the intercept: L-BFGS on the weighted logistic loss with penalty.

    ``indices`` are the features of all rows one after another (every row has some), ``starts`` where each row begins.
    """
    sizes = np.diff(np.append(starts, len(indices)))
    scale = ratio[indices].astype(np.float32)
    total = weights.sum()
    share = (weights * labels).sum() / total
    rows = np.repeat(np.arange(len(labels), dtype=np.int32), sizes)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.add.reduceat(scale * x[indices], starts) + x[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        value = (weights * (np.logaddexp(0, z) - labels * z)).sum() + PENALTY / 2 * (x[:-1] ** 2).sum()
        miss = weights * (p - labels)
        grad = PENALTY * x
        grad[:-1] += np.bincount(indices, weights=scale * miss[rows], minlength=BUCKETS)
        grad[-1] = miss.sum()
        return value, grad

    x = np.zeros(BUCKETS + 1)
    x[-1] = np.log(share / (1 - share))
    value, grad = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        step, memory = grad.copy(), []
        for s, y in reversed(past):
            a = (s @ step) / (y @ s)
            step -= a * y
            memory.append(a)
        step *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(grad))
        for (s, y), a in zip(past, reversed(memory)):
            step += (a - (y @ step) / (y @ s)) * s
        rate = 1.0
        for _ in range(25):
            then, slope = loss(x - rate * step)
            if then <= value - 1e-4 * rate * (grad @ step):
                break
            rate /= 2
        else:
            break
        pair = (-rate * step, slope - grad)
        x, gain, value, grad = x - rate * step, value - then, then, slope
        if pair[0] @ pair[1] > 1e-12:
            past = [*past[-6:], pair]
        if gain < 1e-6 * abs(value):
            break
    return x[:-1] * ratio, float(x[-1])


@dataclass
class Model:
    weights: np.ndarray
    intercept: float


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled documents. ``docs`` has ``doc_id`` and ``text``; ``labels`` has ``doc_id`` and ``toxic``."""
    known = written(
        labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")), "labels",
    )
    by_class = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).filter("toxic in (0, 1)").collect()}
    toxic, other = by_class.get(1, 0), by_class.get(0, 0)
    if not toxic or not other:
        share = (toxic + SMOOTH) / (toxic + other + 2 * SMOOTH)
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    near = (lambda t: F.broadcast(t)) if toxic + other <= SENT_LABELS else (lambda t: t)
    labelled = docs.select("doc_id", "text").join(near(known), "doc_id")
    counts = labelled.select("toxic", "text").mapInArrow(count_features, "bucket bigint, p bigint, q bigint").groupBy("bucket").agg(
        F.sum("p").alias("p"), F.sum("q").alias("q"),
    ).toArrow()  # at most BUCKETS rows
    p, q = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts["bucket"].to_numpy()
    p[at], q[at] = counts["p"].to_numpy(), counts["q"].to_numpy()
    ratio = np.log(((p + SMOOTH) / (toxic + 2 * SMOOTH)) / ((q + SMOOTH) / (other + 2 * SMOOTH)))
    ratio[(p + q) == 0] = 0
    rate = F.when(F.col("toxic") == 1, F.lit(min(1.0, FIT_ROWS / toxic))).otherwise(F.lit(min(1.0, FIT_ROWS / other)))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate * (1 << 30)).withColumn("weight", 1 / rate)
    # Ids in order: the fit does not depend on how rows reach it.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "weight", "text")
    sample = written(sample, "sample").repartitionByRange(8, "doc_id").select("toxic", "weight", "text").mapInArrow(
        list_features, "toxic int, weight double, found array<int>",
    )
    ratio32 = ratio.astype(np.float32)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        found = [np.asarray(b.column("found").flatten()) for b in rows]
        sizes = np.concatenate([b.column("found").value_lengths().to_numpy() for b in rows])
        weights, intercept = fit_logistic(
            np.concatenate(found), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64),
            np.concatenate([b.column("toxic").to_numpy() for b in rows]).astype(float), np.concatenate([b.column("weight").to_numpy() for b in rows]), ratio32,
        )
        there = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(there, -1)), pa.array(np.append(weights[there], intercept))], names=["bucket", "weight"],
        )

    fitted = sample.coalesce(1).mapInArrow(fit, "bucket bigint, weight double").toArrow()  # at most BUCKETS + 1 rows
    weights = np.zeros(BUCKETS + 1)
    weights[fitted["bucket"].to_numpy()] = fitted["weight"].to_numpy()
    return Model(weights[:-1].copy(), float(weights[-1]))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns but the text, and ``score``. The model is ``BUCKETS`` numbers, sent to every executor once."""
    kept = [f for f in docs.schema.fields if f.name not in (text, "score")]
    names = [f.name for f in kept]
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = sent.value
        seen = Seen()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            z = np.array([weights[seen.of(t.as_py())].sum(dtype=np.float64) for t in texts]) + intercept
            scores = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(scores, pa.float64())], names=[*names, "score"],
            )

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType())]))
