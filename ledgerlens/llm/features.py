"""Hashed word and character n-gram features, and small numpy trainers."""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of each of the two blocks: word 1- and 2-grams, character 3-grams.
BUCKETS = 2048
WIDTH = 2 * BUCKETS
#: At most so many labelled (and, for a classifier that takes them, unlabelled)
#: rows are fitted; those with the smallest hash of doc_id, so the choice
#: does not depend on order or partitions.  Scoring covers all rows.
MAX_FIT_ROWS = 4000


def features(raw: bytes, words: list[bytes]) -> np.ndarray:
    """Square roots of the n-grams' shares, one block after the other."""
    out = np.zeros(WIDTH, np.float32)
    if words:
        h = np.fromiter(map(crc32, words), np.uint64, len(words))
        pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:] * np.uint64(0x85EBCA77)) >> np.uint64(20)
        grams = np.concatenate([h, pairs]) % np.uint64(BUCKETS)
        counts = np.bincount(grams.astype(np.int64), minlength=BUCKETS)
        out[:BUCKETS] = np.sqrt(counts / counts.sum())
    if len(raw) >= 3:
        c = np.frombuffer(raw, np.uint8).astype(np.uint32)
        grams = ((c[:-2] << 16 | c[1:-1] << 8 | c[2:]) * np.uint32(2654435761)) >> np.uint32(21)
        counts = np.bincount(grams, minlength=BUCKETS)
        out[BUCKETS:] = np.sqrt(counts / counts.sum())
    return out


def text_features(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "replace")
    return features(raw, raw.split())


def repeat_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs at least twice in the text."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    if len(np.unique(mixed)) == len(mixed):  # equal windows have equal hashes, so none repeats
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    inside = np.zeros(len(words), bool)
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside[i : i + 3] = True
    return int(inside.sum())


SHAPE = 4


def shape_features(raw: bytes, words: list[bytes]) -> np.ndarray:
    """Repetition and make-up of a text: shares between 0 and 1."""
    n = max(1, len(words))
    letters = np.frombuffer(raw, np.uint8)
    upper = np.count_nonzero((letters >= 65) & (letters <= 90))
    lower = np.count_nonzero((letters >= 97) & (letters <= 122))
    return np.array(
        [repeat_words(words) / n, len(set(words)) / n, upper / max(1, upper + lower), min(1, len(words) / 50)], np.float32
    )


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def bounded_ids(rows: DataFrame, bound: int = MAX_FIT_ROWS) -> DataFrame:
    """The ``bound`` rows with the smallest hash of their doc_id."""
    return rows.where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def fit_matrix(docs: DataFrame, chosen: DataFrame, vector=text_features, width=WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Features and ``y`` of the documents that ``chosen`` (doc_id, y) names.

    ``chosen`` has at most ``MAX_FIT_ROWS`` rows, so it can be broadcast and
    the sparse features come to the driver; no text does.
    """

    def run(batches):
        for batch in batches:
            xs = [vector(t.as_py()) for t in batch.column("text")]
            at = [np.flatnonzero(x).astype(np.int32) for x in xs]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("y"),
                    pa.array(at, pa.list_(pa.int32())),
                    pa.array([x[i] for x, i in zip(xs, at)], pa.list_(pa.float32())),
                ],
                names=["doc_id", "y", "at", "value"],
            )

    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen.select("doc_id", F.col("y").cast("double"))), "doc_id")
        .groupBy("doc_id", "y")  # one text for an id that many rows share
        .agg(F.min("text").alias("text"))
        .mapInArrow(run, "doc_id long, y double, at array<int>, value array<float>")
        .toArrow()
    )
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")[:MAX_FIT_ROWS]
    x = np.zeros((len(order), width), np.float32)
    at, value = rows["at"].combine_chunks(), rows["value"].combine_chunks().values.to_numpy()
    ends, at = at.offsets.to_numpy(), at.values.to_numpy()
    for k, i in enumerate(order):
        own = slice(ends[i], ends[i + 1])
        x[k, at[own]] = value[own]
    return x, rows["y"].to_numpy()[order]


class Adam:
    """Adam steps for one parameter vector."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        m, v = self.m / (1 - 0.9**self.t), self.v / (1 - 0.999**self.t)
        return self.rate * m / (np.sqrt(v) + 1e-8)


def one_label_per_document(labels: DataFrame) -> DataFrame:
    """``(doc_id, y)``: the majority of a document's labels, 0 in a tie."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("y"))
