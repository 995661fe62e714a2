"""Quality classifier by positive-unlabelled learning.

Trusted positives are the training fold's rows labelled 1; unlabelled rows are
all web text of the training fold, whatever its label says.  A linear model over
hashed n-grams and repetition shares minimises the non-negative unbiased risk

    prior * R_pos(+1) + max(0, R_unl(-1) - prior * R_pos(-1))

No label 0 is ever used.  The class prior is estimated from positives and
unlabelled rows alone: two discriminators, each trained on one half, score the
other half, and among all thresholds the one with the least upper bound of
share(unlabelled above) / share(positives above) gives the prior (best bin
estimation).

At most ``max_rows`` positives, which are labelled rows, and as many unlabelled
rows come to the driver.  The unlabelled risk is nevertheless that of all
unlabelled rows: the driver's rows give first weights, one pass over the training
fold sums loss and gradient of every unlabelled row at those weights and counts
the discriminators' scores, and the final fit minimises the risk of the driver's
rows shifted to agree with those sums in value and gradient (the surrogate
likelihood of communication-efficient distributed estimation).  So nothing is
left out, and what is gathered is one vector a task, summed before it is read.

Defined cases: null or blank text has zero features and gets the model's bias
as score; without positives every score is 0.5; documents without a label
are scored like any other; repeated unlabelled rows count as often as they
stand and score alike; an empty table gives an empty result.  Only ``text``
enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import (
    MAX_FIT_ROWS,
    SHAPE,
    WIDTH,
    Adam,
    bounded_ids,
    features,
    fit_matrix,
    one_label_per_document,
    shape_features,
    sigmoid,
)
from .shared import spread, table

FOLDS, HELD_OUT = 3, 1
#: Steps of a fit, and of one whose scores only need to be ordered.
STEPS, SHORT, RATE, RIDGE = 600, 200, 0.1, 1e-4
#: Bins of scores between 0 and 1, and the chance that the bounds of a share do not hold.
BINS, UNSURE = 1000, 0.1


def held_out(column: str = "doc_id"):
    """crc32 of the id's decimal text, modulo ``FOLDS``; a null id trains nothing."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def vector(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    return np.concatenate([features(raw, words), shape_features(raw, words)])


class Shift:
    """What the mean loss and gradient of all unlabelled rows add to those of the driver's, at weights ``at``."""

    def __init__(self, at: np.ndarray, loss: float = 0.0, gradient: np.ndarray | float = 0.0):
        self.at, self.loss, self.gradient = at, loss, gradient + np.zeros(len(at))


def mean_gradient(x: np.ndarray, error: np.ndarray) -> np.ndarray:
    return np.append(x.T @ (error / len(x)).astype(np.float32), error.mean())


def margins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(np.float32) + w[-1]


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, shift: Shift | None = None) -> np.ndarray:
    """Weights and a bias that minimise the non-negative PU risk (log loss), from those of ``shift`` on."""
    w = np.zeros(pos.shape[1] + 1) if shift is None else shift.at.copy()
    shift = shift or Shift(w.copy())
    adam = Adam(len(w), RATE)
    for _ in range(STEPS):
        zp, zu = margins(pos, w), margins(unl, w)
        unlabelled_risk = np.logaddexp(0, zu).mean() + shift.loss + (w - shift.at) @ shift.gradient
        negative_risk = unlabelled_risk - prior * np.logaddexp(0, zp).mean()
        negative = mean_gradient(unl, sigmoid(zu)) + shift.gradient - prior * mean_gradient(pos, sigmoid(zp))
        if negative_risk < 0:  # step back from the over-fitted part alone
            grad = -negative
        else:
            grad = prior * mean_gradient(pos, sigmoid(zp) - 1) + negative
        grad[:-1] += RIDGE * w[:-1]
        w -= adam.step(grad)
    return w


def fit_discriminator(pos: np.ndarray, unl: np.ndarray) -> np.ndarray:
    """Logistic regression of positives against unlabelled rows, both of equal weight."""
    w = np.zeros(pos.shape[1] + 1)
    adam = Adam(len(w), RATE)
    for step in range(SHORT if len(pos) and len(unl) else 0):
        adam.rate = RATE * (1 - step / SHORT)
        grad = mean_gradient(pos, sigmoid(margins(pos, w)) - 1) + mean_gradient(unl, sigmoid(margins(unl, w)))
        grad[:-1] += RIDGE * w[:-1]
        w -= adam.step(grad)
    return w


def bins_of(z: np.ndarray) -> np.ndarray:
    return np.minimum((sigmoid(z) * BINS).astype(np.int64), BINS - 1)


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives in unlabelled rows, from counts of both by bins of a score that is higher for positives."""
    n_pos, n_unl = pos.sum(), unl.sum()
    if not n_pos or not n_unl:
        return 0.5
    above_pos, above_unl = pos[::-1].cumsum() / n_pos, unl[::-1].cumsum() / n_unl
    some = above_pos > 0
    noise = np.sqrt(np.log(4 / UNSURE) / (2 * n_unl)) + np.sqrt(np.log(4 / UNSURE) / (2 * n_pos))
    bound = (above_unl[some] + 1.01 * noise) / above_pos[some]
    best = int(bound.argmin())
    return float(np.clip(above_unl[some][best] / above_pos[some][best], 0.01, 0.99))


def half(column: str = "doc_id"):
    """Which discriminator has not seen a row: 0 or 1."""
    return F.pmod(F.xxhash64(column), F.lit(2)).cast("int")


def unlabelled_sums(rows: DataFrame, at: np.ndarray, discriminators: list[np.ndarray]) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Count, summed loss, summed gradient and score counts of all ``rows`` (text, half).

    A task adds up its rows and gives one vector; those are summed by place, so
    the driver reads as many numbers as one vector has.
    """
    width = len(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 + width + BINS)
        for batch in batches:
            for text, own in zip(batch.column("text"), batch.column("half").to_pylist()):
                x = vector(text.as_py())
                z = float(x @ at[:-1] + at[-1])
                error = float(sigmoid(z))
                sums[0] += 1
                sums[1] += np.logaddexp(0, z)
                sums[2 : 1 + width] += error * x
                sums[1 + width] += error
                w = discriminators[own]
                sums[2 + width + bins_of(np.array(x @ w[:-1] + w[-1]))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = spread(rows).mapInArrow(run, "sums array<double>")
    total = parts.select(F.posexplode("sums").alias("place", "n")).groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(2 + width + BINS)
    sums[total["place"].to_numpy()] = total["n"].to_numpy()
    return int(sums[0]), sums[1], sums[2 : 2 + width], sums[2 + width :]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> np.ndarray:
    known = one_label_per_document(labels.where(~held_out()))
    web = docs.where(~held_out() & F.col("doc_id").isNotNull())

    def chosen(ids):
        return fit_matrix(docs, bounded_ids(ids.select("doc_id"), max_rows).withColumn("y", half()), vector, WIDTH + SHAPE)

    pos, pos_half = chosen(known.where("y = 1"))
    if not len(pos):
        return np.zeros(WIDTH + SHAPE + 1)
    unl, unl_half = chosen(web.select("doc_id").distinct())
    if not len(unl):
        return np.zeros(WIDTH + SHAPE + 1)
    judges = [fit_discriminator(pos[pos_half != k], unl[unl_half != k]) for k in (0, 1)]

    def counts(x, own):
        return sum(np.bincount(bins_of(margins(x[own == k], judges[k])), minlength=BINS) for k in (0, 1))

    first = fit_nnpu(pos, unl, estimate_prior(counts(pos, pos_half), counts(unl, unl_half)))
    n, loss, gradient, scores = unlabelled_sums(web.select("text", half().alias("half")), first, judges)
    zu = margins(unl, first)
    shift = Shift(first, loss / n - np.logaddexp(0, zu).mean(), gradient / n - mean_gradient(unl, sigmoid(zu)))
    return fit_nnpu(pos, unl, estimate_prior(counts(pos, pos_half), scores), shift)


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    w = weights.astype(np.float32)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            scores = [float(sigmoid(vector(t.as_py()) @ w[:-1] + w[-1])) for t in batch]
            yield pa.array(scores, pa.float64())

    score = F.arrow_udf(run, "double").asNondeterministic()
    scored = spread(docs.select("doc_id", "text")).select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))


QUERIES = {"op3_pu_quality": op3_pu_quality}
