"""A linear softmax classifier of texts over hashed words and binned text statistics.

It is fitted on the driver on a sample of labelled rows of bounded size (SAMPLE, chosen by a hash
of the id), and applied to all documents where they lie: the weights are a fixed size, there is no
shuffle of texts. The sample's features come to the driver in parts and lie there in a temporary file,
so that its memory doesn't depend on how long the texts are.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialise
from ._text import Words, mix, raw, slices

SAMPLE, BUCKETS, STEPS, BINS = 20_000, 1 << 16, 80, 16
#: Features that a step looks at at once, and bytes of features that come to the driver at once.
CHUNK, PART_BYTES = 1 << 20, 8 << 20
_CLASS = np.zeros(256, np.uint8)  # 1: symbols, 2: capitals, 3: digits, 4: letters, 5: white
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_CLASS[65:91], _CLASS[48:58], _CLASS[97:123], _CLASS[128:] = 2, 3, 4, 4
_CLASS[[9, 10, 13, 32]] = 5
_CLASS[[33, 44, 46, 63]] = 0  # ordinary punctuation


def _held(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of each text's bytes are marked."""
    counted = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=counted[1:], dtype=np.int32)
    return np.diff(counted[at])


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature, sorted and distinct: hashed words, and one bin for each statistic."""
    words = Words(column)
    data, at = raw(column)
    kinds = _CLASS[data]
    total = np.maximum(np.diff(at), 1)
    share = [_held(kinds == c, at) / total for c in (1, 2, 3, 5)]
    n = np.diff(words.first)
    i = np.arange(len(words.doc))
    h = words.spans(i, i)
    same = np.zeros(len(h) + 1, np.int64)
    if len(h) > 1:
        same[2:] = np.cumsum((h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1]))
    again = np.diff(same[words.first]) / np.maximum(n, 1)
    stats = [np.minimum(np.sqrt(s) * BINS, BINS - 1) for s in [*share, again]]
    stats += [np.minimum(total / np.maximum(n, 1), BINS - 1), np.minimum(np.log2(1 + n), BINS - 1)]
    rows = np.arange(words.n)
    binned = [BUCKETS + k * BINS + s.astype(np.int64) for k, s in enumerate(stats)]
    width = BUCKETS + len(stats) * BINS
    keys = np.concatenate([words.doc * width + (h % np.uint64(BUCKETS)).astype(np.int64), *(rows * width + b for b in binned)])
    keys.sort()
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
    row = keys // width
    return row, keys - row * width


WIDTH = BUCKETS + 7 * BINS
#: A statistic counts as much as several words, or the many words of a text would drown it.
_VALUE = np.ones(WIDTH)
_VALUE[BUCKETS:] = 10


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _scores(row: np.ndarray, feature: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(row, w[feature], n) for w in weights * _VALUE], axis=1)


def fit(feature: np.ndarray, lengths: np.ndarray, labels: np.ndarray, classes: int, steps: int = STEPS, penalty: float = 1e-3) -> np.ndarray:
    """Weights (classes, WIDTH) by maximum likelihood with an L2 penalty, full-batch Adam. feature: those
    of the first row, `lengths` says how many, then those of the next; it may lie in a file."""
    weights, first, second = (np.zeros((classes, WIDTH)) for _ in range(3))
    n = len(lengths)
    if not n:
        return weights
    ends, cuts = np.cumsum(lengths), [0]  # every text has features, as statistics are some
    while cuts[-1] < n:
        base = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, base + CHUNK, "right"))))
    wanted = np.eye(classes)[labels]
    for step in range(1, steps + 1):
        held = np.zeros((classes, WIDTH))
        for a, b in zip(cuts[:-1], cuts[1:]):
            starts = ends[a:b] - lengths[a:b]
            part = feature[starts[0] : ends[b - 1]].astype(np.intp)
            scores = np.stack([np.add.reduceat(w[part], starts - starts[0]) for w in weights * _VALUE], axis=1)
            error = (softmax(scores) - wanted[a:b]) / n
            for c in range(classes):
                held[c] += np.bincount(part, np.repeat(error[:, c], lengths[a:b]), WIDTH)
        slope = held * _VALUE + penalty * weights
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        weights = weights - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return weights


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            row, feature = text_features(part.column("text"))
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            feature = feature.astype(np.int32)
            features = pa.array([feature[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())
            yield pa.record_batch([*(part.column(c) for c in _PLACE), part.column("label"), features], names=[*_PLACE, "label", "features"])


#: The order of labelled rows, of which the first ones are the sample.
_PLACE = ["place", "id_text", "text_hash"]


def train(docs: DataFrame, labels: DataFrame, label: Column, classes: int, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Weights fitted on at most `sample` labelled rows, those with the least hashes of the id, then
    by id, label and hash of the text. label is a class number over the columns of labels; null
    leaves the row out."""
    chosen = (
        labels.select(F.col(id_col).alias("id"), label.cast("int").alias("label")).where("label IS NOT NULL")
        .orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    placed = texts.select(F.xxhash64("id").alias("place"), F.col("id").cast("string").alias("id_text"), F.xxhash64("text").alias("text_hash"), "label", "text")
    # Rows that agree in the order are alike; a number tells them apart, so that they needn't share a partition.
    order = [*_PLACE[:2], "label", _PLACE[2], "number"]
    found = materialise(
        placed.mapInArrow(_collect, "place long, id_text string, text_hash long, label int, features binary").withColumn("number", F.monotonically_increasing_id()), "labelled-features"
    )
    parts = max(1, -(-(found.agg(F.sum(F.length("features"))).first()[0] or 0) // PART_BYTES))
    rows = found.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("label", "features").toLocalIterator()
    known, lengths = [], []
    with tempfile.TemporaryFile() as file:
        for label_, features in islice(rows, sample):
            file.write(features)
            known.append(label_)
            lengths.append(len(features) // 4)
        file.flush()
        feature = np.memmap(file, np.int32, "r") if lengths else np.zeros(0, np.int32)
        return fit(feature, np.array(lengths, np.int64), np.array(known, np.int64), classes)


def posteriors(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    row, feature = text_features(column)
    return softmax(_scores(row, feature, len(column), weights))
