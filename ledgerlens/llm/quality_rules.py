"""Quality rules: text statistics and a calibrated hashed n-gram classifier.

A logistic regression over hashed word and character n-grams is fitted to a
bounded sample of labelled rows; Platt scaling on rows that the fit has not
seen turns its margin into a probability; documents are scored whole, in Arrow
batches, against fixed thresholds.

Defined cases: null or blank text has no words and fails the base rule; without
usable labels of both kinds the classifier abstains (probability 1) and the
base rule decides alone; repeated rows are judged alike; an empty table gives an
empty result; further columns of any name pass through ``filter_quality``
untouched; a text is judged whole, in memory in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import (
    MAX_FIT_ROWS,
    WIDTH,
    Adam,
    bounded_ids,
    features,
    fit_matrix,
    one_label_per_document,
    repeat_words,
    sigmoid,
)
from .shared import free_name, spread, table

MIN_WORDS, MAX_REPEAT_PERCENT, KEEP_FROM = 50, 50, 0.5
SYMBOLS = "#*$%&|<>"
STEPS, RATE, RIDGE = 300, 0.1, 1e-4

STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, quality_prob double, kept boolean"
)


def dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.encode("utf-8", "replace").strip():
            n += line in seen
            seen.add(line)
    return n


def statistics(text: str, raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        sum(map(text.count, SYMBOLS)),
        dup_lines(text),
        repeat_words(words),
    )


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and a bias, by full-batch Adam on the ridge-penalised log loss."""
    w = np.zeros(x.shape[1] + 1)
    adam = Adam(len(w), RATE)
    for _ in range(STEPS):
        error = sigmoid(x @ w[:-1].astype(np.float32) + w[-1]) - y
        grad = np.append(x.T @ error.astype(np.float32) / len(y) + RIDGE * w[:-1], error.mean())
        w -= adam.step(grad)
    return w


def fit_platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """``(a, b)`` of ``sigmoid(a * margin + b)``, by Newton steps with soft targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    design, ab = np.c_[margin, np.ones(len(margin))], np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(design @ ab)
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, design.T @ (p - target))
        ab -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(ab[0], 1e-3)), float(ab[1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> np.ndarray | None:
    """Calibrated weights (bias last), or None without labels of both kinds."""
    x, y = fit_matrix(docs, bounded_ids(one_label_per_document(labels), max_rows))
    aside = np.zeros(len(y), bool)
    for kind in (0, 1):
        aside[np.flatnonzero(y == kind)[::4]] = True
    if len({*y[aside]}) < 2 or len({*y[~aside]}) < 2:
        return None
    w = fit_logistic(x[~aside], y[~aside])
    a, b = fit_platt(x[aside] @ w[:-1].astype(np.float32) + w[-1], y[aside])
    return np.append(a * w[:-1], a * w[-1] + b)


def verdicts(weights: np.ndarray | None):
    """A UDF from a text to the struct ``STATS``: only the text leaves the JVM, and no text returns."""
    w = np.zeros(WIDTH + 1, np.float32) if weights is None else weights.astype(np.float32)
    names = [c.split()[0] for c in STATS.split(", ")]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for text in batch:  # one at a time: a batch is not held twice
                text = text.as_py() or ""
                raw = text.encode("utf-8", "replace")
                words = raw.split()
                stats = statistics(text, raw, words)
                failed = base_failed(stats[0], stats[4])
                prob = 1.0 if weights is None else float(sigmoid(features(raw, words) @ w[:-1] + w[-1]))
                rows.append((*stats, failed, prob, not failed and prob >= KEEP_FROM))
            columns = zip(*rows) if rows else [()] * len(types)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    # not deterministic by declaration, so that a filter above does not run it once more
    return F.arrow_udf(run, f"struct<{STATS.replace(' ', ':').replace(',:', ',')}>").asNondeterministic()


def judge(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """All columns of ``docs`` and those of ``STATS`` (which replace equal names)."""
    own = [c.split()[0] for c in STATS.split(", ")]
    name = free_name(docs, "verdict")
    judged = spread(docs).withColumn(name, verdicts(weights)("text"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return judged.select(*kept, *[F.col(name)[c].alias(c) for c in own])


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    name = free_name(docs, "verdict")
    judged = spread(docs).withColumn(name, verdicts(train(docs, labels))("text"))
    return judged.where(F.col(name)["kept"]).drop(name)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = judge(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return judged.drop("text")


QUERIES = {"op5_quality_rules": op5_quality_rules}
