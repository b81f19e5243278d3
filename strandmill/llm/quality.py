"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text in one vectorised pass.  Trees are grown on
quantile-binned histograms and kept as flat arrays (one row per tree, one column
per node of a complete binary tree), so scoring walks all texts of a batch down
all trees with array indexing only.

Defined cases.  Null or empty text: all statistics 0, scored like any other.
No label, or labels of one class: every score is that class's share (0.5
without labels).  Contradicting labels of an id: the largest counts.  Repeated
rows: equal scores.  Empty table: empty result.  Only the id and text columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .shared import crc_mod
from .text_arrays import fold, slices, text_buffer, word_hashes, words

SAMPLE = 20000
BINS = 48
DEPTH = 4
TREES = 80
BLOCK_BYTES = 1 << 21

STATISTICS = (
    "log_words log_bytes word_length word_length_spread log_longest_word upper digit high_bytes stops bars bangs symbols other_marks"
    " line_feeds distinct_words top_word distinct_pairs repeated_lines short_words long_words doubled_words controls"
).split()

_LOWER, _UPPER, _DIGIT, _BLANK, _FEED, _HIGH, _STOP, _BAR, _BANG, _SYMBOL, _MARK, _CONTROL = range(12)
_KIND = np.full(256, _CONTROL, np.uint8)
_KIND[128:] = _HIGH
_KIND[33:127] = _MARK
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"0123456789", _DIGIT), (b" \t", _BLANK), (b"\n\r", _FEED), (b".,", _STOP), (b"|", _BAR), (b"!?", _BANG), (b"#$%&*+=/\\<>@[]^_`{}~", _SYMBOL)):
    _KIND[list(_chars)] = _kind


def _repeated(values: np.ndarray) -> tuple[int, int]:
    """(distinct, most frequent) of some hashes."""
    if len(values) == 0:
        return 0, 0
    ordered = np.sort(values)
    edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
    return len(edges) - 1, int(np.diff(edges).max())


def statistics(column: pa.Array) -> np.ndarray:
    """One row of statistics per text."""
    buf, offsets = text_buffer(column)
    out = np.zeros((len(offsets) - 1, len(STATISTICS)), np.float32)
    for i, j in slices(offsets, BLOCK_BYTES):
        part, bounds = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, end, first = words(part, bounds)
        hashes = word_hashes(part, start, end)
        lengths = end - start
        for k in range(j - i):
            a, b = bounds[k], bounds[k + 1]
            u, v = first[k], first[k + 1]
            n, size = max(v - u, 1), max(b - a, 1)
            if a == b:
                continue
            text = part[a:b]
            kinds = np.bincount(_KIND[text], minlength=12)
            h, length = hashes[u:v], lengths[u:v]
            distinct, top = _repeated(h)
            pairs, _ = _repeated(fold(h[:-1], h[1:])) if v - u > 1 else (1, 1)
            lines = [x for x in text.tobytes().split(b"\n") if x]
            out[i + k] = (
                np.log1p(v - u), np.log1p(b - a), length.mean() if v > u else 0, length.std() if v > u else 0, np.log1p(length.max()) if v > u else 0,
                kinds[_UPPER] / size, kinds[_DIGIT] / size, kinds[_HIGH] / size, kinds[_STOP] / n, kinds[_BAR] / n, kinds[_BANG] / n,
                kinds[_SYMBOL] / n, kinds[_MARK] / n, kinds[_FEED] / n, distinct / n, top / n, pairs / max(n - 1, 1),
                1 - len(set(lines)) / max(len(lines), 1), (length <= 3).sum() / n, (length >= 12).sum() / n, (h[1:] == h[:-1]).sum() / n, kinds[_CONTROL] / size,
            )
    return out


@dataclass
class Trees:
    """Complete binary trees as arrays: inner nodes (tree, node), leaves (tree, leaf)."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += leaf[node - inner]
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = 0.1, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boosted trees on binned features by second-order logistic loss."""
    n, positive = len(y), float(y.sum())
    inner, leaves = (1 << depth) - 1, 1 << depth
    share = min(max(positive / n if n else 0.5, 1e-6), 1 - 1e-6)
    model = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)), float(np.log(share / (1 - share))))
    if n == 0 or positive in (0, n):
        return model
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1).astype(np.int64)
    limits = np.full((width, bins), np.inf, np.float32)
    for f, c in enumerate(cuts):
        limits[f, : len(c)] = c
    spread = binned + np.arange(width) * bins
    margin = np.full(n, model.base)
    feature, threshold, leaf = (np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, leaves)))
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            count = 1 << level
            at = ((node - (count - 1)) * (width * bins))[:, None] + spread
            g, h = (np.bincount(at.ravel(), weights=np.repeat(w, width), minlength=count * width * bins).reshape(count, width, bins) for w in (grad, hess))
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least) | ~np.isfinite(limits)[None]] = -1
            best = gain.reshape(count, -1).argmax(1)
            good = gain.reshape(count, -1).max(1) > 1e-9
            own = slice(count - 1, 2 * count - 1)
            feature[t, own] = np.where(good, best // bins, 0)
            threshold[t, own] = np.where(good, limits[best // bins, best % bins], np.inf)
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        g, h = (np.bincount(node - inner, weights=w, minlength=leaves) for w in (grad, hess))
        leaf[t] = -rate * g / (h + ridge)
        margin += leaf[t, node - inner]
    model.feature, model.threshold, model.leaf = feature, threshold, leaf
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """Fit on the statistics of at most ``sample`` labelled rows outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([r.tobytes() for r in statistics(batch.column("text"))], pa.binary())], names=["label", "row"])

    table = labelled_sample(docs, labels, label_col, sample, id_col, text_col).mapInArrow(run, "label int, row binary").toArrow()
    x = np.frombuffer(b"".join(table.column("row").to_pylist()), np.float32).reshape(-1, len(STATISTICS))
    y = table.column("label").to_numpy().astype(np.float64)
    order = np.lexsort([*x.T, y])
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_mod(id_col, 3) == 1).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
