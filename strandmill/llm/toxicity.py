"""Toxicity: a character n-gram linear classifier with naive Bayes log-count ratios.

A text is the set of its word-bounded byte n-grams (4 to 6 bytes, ASCII lower-
cased, hashed).  Each n-gram is scaled by the log ratio of its smoothed document
frequencies among toxic and other labelled texts; a logistic regression is
trained on the scaled features.

Whole texts are read, long ones in overlapping windows that change no n-gram:
n-grams are marked in a table of fixed size, so memory is that table and a small
multiple of the text itself.

N-grams in fewer than LEAST_DOCS sampled texts, or with an absolute log-count
ratio under LEAST_RATIO, weigh nothing.  Where no n-gram passes (very few
labels), every text has the score that the shares of the labels give.

Defined cases.  Null or empty text: the model's intercept as score.  No labels
of one of the classes: every score is the share of label 1 (0.5 without any
label).  Contradicting labels of an id: the largest counts.  Repeated rows:
equal scores.  Empty table: empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .shared import crc_mod, stored
from .text_arrays import U64, text_buffer

BITS = 18
ORDERS = (4, 5, 6)
SAMPLE = 6000
THRESHOLD = 0.7
LEAST_DOCS, LEAST_RATIO = 5, 1.0
PIECE = 1 << 18

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_MULT = {n: U64((0x9E3779B97F4A7C15 * (2 * n + 1)) % (1 << 64) | 1) for n in range(1, 9)}


def present(data: np.ndarray, seen: np.ndarray) -> None:
    """Mark the n-grams of one text (bytes), framed by one space on either side, in ``seen``.

    The framed text is read in overlapping windows: each holds the n-grams that
    start in its first PIECE bytes, so the windows' n-grams are the text's.
    """
    widest, space = max(ORDERS), np.full(1, 32, np.uint8)
    framed = np.concatenate([space, _FOLD[data], space])
    for at in range(0, len(framed), PIECE):
        piece = framed[at : at + PIECE + widest - 1]
        gram = piece.astype(np.uint64)
        gap = np.concatenate([[0], np.cumsum(piece == 32)])
        for n in range(2, widest + 1):
            gram = (gram[:-1] << U64(8)) | piece[n - 1 :]
            if n in ORDERS and len(gram):
                # No space but at the ends: n-grams stay within one word.
                one_word = gap[n - 1 : len(piece)][: len(gram)] - gap[1 : len(gram) + 1] == 0
                seen[((gram[one_word] * _MULT[n]) >> U64(64 - BITS)).astype(np.int64)] = 1


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted feature ids of every text."""
    buf, offsets = text_buffer(column)
    seen = np.zeros(1 << BITS, np.uint8)
    for a, b in zip(offsets[:-1], offsets[1:]):
        present(buf[a:b], seen)
        ids = np.flatnonzero(seen)
        seen[ids] = 0
        yield ids


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, ids: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.intercept + self.weights[ids].sum(dtype=np.float64), -40, 40))))


def informative(toxic: np.ndarray, other: np.ndarray, positive: int, negative: int, least_docs: int = LEAST_DOCS, least_ratio: float = LEAST_RATIO) -> tuple[np.ndarray, np.ndarray]:
    """(log-count ratios, which to use) from document frequencies among toxic and other texts."""
    ratio = np.log((toxic + 1) / (positive + 2)) - np.log((other + 1) / (negative + 2))
    return ratio, (toxic + other >= least_docs) & (np.abs(ratio) >= least_ratio)


def constant(labels: np.ndarray) -> Model:
    share = min(max(float(labels.mean()) if len(labels) else 0.5, 1e-6), 1 - 1e-6)
    return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))


def fit(rows: list[np.ndarray], labels: np.ndarray, ids: np.ndarray, ratio: np.ndarray, decay: float = 1e-3, steps: int = 200) -> Model:
    """Logistic regression on presence features ``rows`` (indices into ``ids``) scaled by ``ratio``.

    Full-batch accelerated gradient, then one scale and shift of the margin
    (Platt) for the probability.
    """
    n, positive = len(labels), int(labels.sum())
    if positive in (0, n):
        return constant(labels)
    width = max(len(ids), 1)
    cols = np.concatenate(rows).astype(np.int64)
    owner = np.repeat(np.arange(n), [len(k) for k in rows])
    values = ratio[cols] if len(cols) else np.zeros(0)

    def margins(w: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=values * w[cols], minlength=n)

    # The largest eigenvalue of the Gram matrix bounds the step.
    probe = np.ones(width)
    top = 1.0
    for _ in range(8):
        probe = np.bincount(cols, weights=values * margins(probe)[owner], minlength=width)
        top = float(np.linalg.norm(probe)) or 1.0
        probe /= top
    rate = 1.0 / (0.25 * top / n + decay)
    w, ahead, b = np.zeros(width), np.zeros(width), float(np.log(positive / (n - positive)))
    for k in range(steps):
        gap = _sigmoid(margins(ahead) + b) - labels
        new = ahead - rate * (np.bincount(cols, weights=values * gap[owner], minlength=width) / n + decay * ahead)
        b -= 2.0 * float(gap.mean())
        ahead = new + (k / (k + 3)) * (new - w)
        w = new
    z = margins(w) + b
    soft = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (n - positive + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        prob = _sigmoid(a * z + c)
        gap, curve = prob - soft, prob * (1 - prob) + 1e-6
        hess = np.array([[(curve * z * z).sum(), (curve * z).sum()], [(curve * z).sum(), curve.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, np.array([(gap * z).sum(), gap.sum()]))
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        a, c = a - step[0], c - step[1]
    weights = np.zeros(1 << BITS)
    weights[ids] = (a * w * ratio)[: len(ids)] if len(ids) else 0.0
    return Model(weights.astype(np.float32), float(a * b + c))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of ``sample`` labelled rows outside the held-out fold.

    Document frequencies are summed in the cluster; the driver gets the used
    n-grams and, for each sampled row, which of them it holds.
    """
    rows = stored(labelled_sample(docs, labels, label_col, sample, id_col, text_col), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for ids, label in zip(features(batch.column("text")), batch.column("label").to_pylist()):
                found[label, ids] += 1
        some = np.flatnonzero(found.any(axis=0))
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(found[1, part]), pa.array(found[0, part])], names=["id", "toxic", "other"])

    sizes = rows.agg(F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative")).first()
    positive, negative = sizes["positive"], sizes["negative"]
    if not positive or not negative:
        return constant(np.repeat([1.0, 0.0], [positive, negative]))
    counts = rows.mapInArrow(count, "id int, toxic long, other long").groupBy("id").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where(F.col("toxic") + F.col("other") >= LEAST_DOCS)
    # At most 2^BITS rows.
    table = counts.toArrow().sort_by("id")
    ids, toxic, other = (table.column(c).to_numpy() for c in ("id", "toxic", "other"))
    ratio, used = informative(toxic, other, positive, negative)
    ids, ratio = ids[used].astype(np.int64), ratio[used]
    place = np.full(1 << BITS, -1, np.int32)
    place[ids] = np.arange(len(ids))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [(at := place[x])[at >= 0].tobytes() for x in features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(packed, pa.binary())], names=["label", "held"])

    held = rows.mapInArrow(pick, "label int, held binary").toArrow()
    lists = [np.frombuffer(x.as_buffer(), np.int32) for x in held.column("held")]
    return fit(lists, held.column("label").to_numpy().astype(np.int64), ids, ratio)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(x) for x in features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_mod(id_col, 3) == 1).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows whose text the model rejects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.score(x) < threshold for x in features(batch.column(text_col))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
