"""Language-model scores by a log-bilinear model trained with noise contrast.

Tokens are words in lower case (A-Z) and an end token per text.  Corpus counts
cover every training text.  The neural model predicts one of 512 outputs: the
end, the most frequent words and 64 classes of all other words (by the last two
bytes).  With context words i = 1, 2 the score of output w is

    s(w) = (A1 r1 + A2 r2) . q_w + b_w

(Mnih and Hinton's log-bilinear form).  The training texts are dealt by hash into
shards, as many as the corpus has tokens for; each trains in numpy, by
noise-contrastive estimation with unigram noise, and the shards' parameters are
averaged by token count after each of ``ROUNDS`` passes.  For scoring, batched matrix products give every context's normaliser,
so the outputs' probabilities sum to one.  A word of a class shares the class's
probability in proportion to its add-one count, an unseen word counting as one,
so the model's scores are probabilities over the vocabulary and comparable with
the base scores.

Counts of the ``HEAD`` most frequent words are broadcast; the others' are joined,
so no table that grows with the corpus passes through the driver or a worker.

Defined cases: null and empty text is the end token alone; a null doc_id is in
training; repeated rows count and score as separate texts; an empty table gives
an empty result.  Columns other than ``doc_id`` and ``text`` are not read.  A text
of any length is one sequence, in memory in proportion to it.
"""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import spread, table, written

FOLDS, HELD_OUT = 7, 2
HEAD = 131_072
OUTPUTS, CLASSES = 512, 64
WORDS = OUTPUTS - CLASSES - 1
END, START = 0, OUTPUTS  # START is a context only
FIRST_CLASS = 1 + WORDS
WIDTH, NOISE, NOISE_RATIO, BATCH, CHUNK = 24, 64, 16.0, 4096, 1_000_000
ROUNDS = (0.2, 0.1)  # learning rate of each pass
COUNTED_AT_ONCE = 400_000
FAN_IN, TOKENS_A_SHARD, SHARDS = 8, 4_000_000, 4096


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def class_of(suffix: bytes) -> int:
    return FIRST_CLASS + crc32(suffix) % CLASSES


class Suffixes(dict):
    """Class of a word's last two bytes, computed once each."""

    def __missing__(self, suffix):
        self[suffix] = found = class_of(suffix)
        return found


# --- corpus counts ---------------------------------------------------------


def word_counts(training: DataFrame) -> DataFrame:
    """``word, c`` of all texts; the end token is the empty word."""

    def batch_of(counts):
        words = pa.array([w.decode() for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], names=["word", "c"])

    def run(batches):
        counts = Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(tokens(text.as_py()))
                counts[b""] += 1
                if len(counts) > COUNTED_AT_ONCE:
                    yield batch_of(counts)
                    counts = Counter()
        yield batch_of(counts)

    return spread(training.select("text")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> dict:
    """Totals, the most frequent words and the classes' add-one mass."""
    end = F.coalesce(F.sum(F.when(F.col("word") == "", F.col("c"))), F.lit(0))
    total, distinct, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), end).head()
    head = counts.where("word <> ''").orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    head = dict(zip((w.encode() for w in head["word"].to_pylist()), head["c"].to_pylist()))
    chosen = [*head][:WORDS]
    ids = {w: 1 + i for i, w in enumerate(chosen)}
    suffix = F.crc32(F.substring(F.col("word").cast("binary"), -2, 2)) % CLASSES
    per_class = counts.where("word <> ''").groupBy(suffix.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    seen, mass = np.zeros(OUTPUTS), np.ones(CLASSES)
    for k, c, v in per_class.collect():  # at most CLASSES rows
        seen[FIRST_CLASS + k] += c
        mass[k] += c + v
    for w, i in ids.items():
        k = class_of(w[-2:])
        seen[i] = head[w]
        seen[k] -= head[w]
        mass[k - FIRST_CLASS] -= head[w] + 1
    seen[END] = ends
    return {"total": total, "distinct": distinct, "ends": ends, "head": head, "ids": ids, "seen": seen, "mass": mass}


# --- the model ---------------------------------------------------------------


def shapes() -> dict[str, tuple]:
    return {"r": (OUTPUTS + 1, WIDTH), "q": (OUTPUTS, WIDTH), "a1": (WIDTH, WIDTH), "a2": (WIDTH, WIDTH), "b": (OUTPUTS,)}


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes().items():
        size = math.prod(shape)
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def initial(noise: np.ndarray, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = {name: rng.normal(0, 0.1, shape) for name, shape in shapes().items()}
    parts["a1"], parts["a2"] = parts["a1"] + np.eye(WIDTH), parts["a2"] + 0.5 * np.eye(WIDTH)
    parts["b"] = np.log(noise)
    return np.concatenate([parts[name].ravel() for name in shapes()]).astype(np.float32)


def noise_of(seen: np.ndarray) -> np.ndarray:
    return (seen + 0.5) / (seen + 0.5).sum()


def row_sums(rows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by their index ``at``."""
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    first = np.flatnonzero(np.r_[True, sorted_at[1:] != sorted_at[:-1]])
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[sorted_at[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation with Adagrad on one share of the corpus."""

    def __init__(self, flat: np.ndarray, noise: np.ndarray, rate: float, seed: int):
        self.flat = flat.copy()
        self.p = unpack(self.flat)
        self.square = {n: np.full(s, 1e-4, np.float32) for n, s in shapes().items()}
        self.noise, self.log_noise = noise, np.log(NOISE_RATIO * noise).astype(np.float32)
        self.cumulated = np.cumsum(noise)
        self.rate, self.rng, self.seen = rate, np.random.default_rng(seed), 0

    def learn(self, codes: np.ndarray):
        """One pass over n-gram codes, each distinct one weighted by its count."""
        self.seen += len(codes)
        codes, counts = np.unique(codes, return_counts=True)
        order = self.rng.permutation(len(codes))
        batch = min(BATCH, max(128, len(order) // 64))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            context, w = np.divmod(codes[some], OUTPUTS)
            c2, c1 = np.divmod(context, OUTPUTS + 1)
            self.step(c2.astype(np.int16), c1.astype(np.int16), w.astype(np.int16), counts[some].astype(np.float32))

    def step(self, c2, c1, w, weight):
        p = self.p
        weight = weight / weight.sum()
        r1, r2 = p["r"][c1], p["r"][c2]
        pred = r1 @ p["a1"] + r2 @ p["a2"]
        drawn = np.searchsorted(self.cumulated, self.rng.random(NOISE) * self.cumulated[-1]).clip(0, OUTPUTS - 1)
        qw, qn = p["q"][w], p["q"][drawn]
        data = np.einsum("ij,ij->i", pred, qw) + p["b"][w] - self.log_noise[w]
        other = pred @ qn.T + p["b"][drawn] - self.log_noise[drawn]
        g_data = -weight / (1 + np.exp(np.clip(data, -30, 30)))
        g_noise = (weight * np.float32(NOISE_RATIO / NOISE))[:, None] / (1 + np.exp(-np.clip(other, -30, 30)))
        g_pred = g_data[:, None] * qw + g_noise @ qn
        grads = {
            "q": row_sums(g_data[:, None] * pred, w, OUTPUTS),
            "b": np.bincount(w, g_data, OUTPUTS).astype(np.float32),
            "a1": r1.T @ g_pred,
            "a2": r2.T @ g_pred,
            "r": row_sums(g_pred @ p["a1"].T, c1, OUTPUTS + 1) + row_sums(g_pred @ p["a2"].T, c2, OUTPUTS + 1),
        }
        np.add.at(grads["q"], drawn, g_noise.T @ pred)
        np.add.at(grads["b"], drawn, g_noise.sum(0))
        for name, g in grads.items():
            self.square[name] += g * g
            p[name] -= self.rate * 0.25 * g / np.sqrt(self.square[name])


def codes_of(ids: list[int]) -> np.ndarray:
    """N-gram codes of one text: two context outputs and the next output."""
    x = np.array([START, START, *ids, END], np.int64)
    return (x[:-2] * (OUTPUTS + 1) + x[1:-1]) * OUTPUTS + x[2:]


def in_shards(training: DataFrame, tokens: int) -> DataFrame:
    """Training texts in shards that depend on the texts alone, not on how they lie.

    A row's shard and its place there are hashes of the row, so equal tables
    train equal models and no id or source weighs on one task.
    """
    shards = min(SHARDS, max(4, tokens // TOKENS_A_SHARD))
    rows = training.select("text", F.xxhash64("text", "doc_id").alias("turn"), F.xxhash64("doc_id", "text").alias("deal"))
    return rows.repartition(shards, "deal").sortWithinPartitions("turn").select("text")


def train_round(training: DataFrame, flat: np.ndarray, vocab: dict, rate: float) -> np.ndarray:
    """Average, in the order of shards, of what they make of ``flat``, weighted by their tokens."""
    ids, noise = vocab["ids"], noise_of(vocab["seen"])
    shared = training.sparkSession.sparkContext.broadcast((ids, noise, flat))
    names, fields = ["shard", "w", "p"], "shard int, w long, p binary"

    def run(batches):
        ids, noise, flat = shared.value
        classes, held, size = Suffixes(), [], 0
        trainer = Trainer(flat, noise, rate, seed=7)
        for batch in batches:
            for text in batch.column("text"):
                codes = codes_of([ids.get(w) or classes[w[-2:]] for w in tokens(text.as_py())])
                held.append(codes)
                size += len(codes)
                if size >= CHUNK:
                    trainer.learn(np.concatenate(held))
                    held, size = [], 0
        if held:
            trainer.learn(np.concatenate(held))
        if trainer.seen:
            yield row(TaskContext.get().partitionId(), trainer.seen, trainer.flat.astype(np.float64) * trainer.seen)

    def row(shard, weight, values):
        columns = [pa.array([shard], pa.int32()), pa.array([weight], pa.int64()), pa.array([values.tobytes()])]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def total(batches):
        first, weight, values = None, 0, np.zeros(len(flat))
        for batch in batches:
            for shard, w, p in zip(*(batch.column(c).to_pylist() for c in names)):
                first = shard if first is None else first
                weight += w
                values += np.frombuffer(p)
        if weight:
            yield row(first, weight, values)

    parts = in_shards(training, vocab["total"]).mapInArrow(run, fields)
    parts = parts.repartition(FAN_IN, F.pmod("shard", F.lit(FAN_IN))).sortWithinPartitions("shard")
    sums = parts.mapInArrow(total, fields).toArrow().sort_by("shard")  # at most FAN_IN rows
    shared.destroy()
    weight = sum(sums["w"].to_pylist())
    if not weight:
        return flat
    return (sum(np.frombuffer(p) for p in sums["p"].to_pylist()) / weight).astype(np.float32)


def log_normalisers(flat: np.ndarray) -> np.ndarray:
    """Natural log of the normaliser of every context (c2, c1)."""
    p = unpack(flat)
    first, second = p["r"] @ p["a1"], p["r"] @ p["a2"]
    out = np.empty((OUTPUTS + 1, OUTPUTS + 1), np.float32)
    for c2 in range(OUTPUTS + 1):
        logits = (first + second[c2]) @ p["q"].T + p["b"]
        top = logits.max(1)
        out[c2] = np.log(np.exp(logits - top[:, None]).sum(1)) + top
    return out


def log_probabilities(flat: np.ndarray, normalisers: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Natural log of the outputs' probabilities for n-gram codes."""
    p = unpack(flat)
    context, w = np.divmod(codes, OUTPUTS)
    c2, c1 = np.divmod(context, OUTPUTS + 1)
    first, second = p["r"] @ p["a1"], p["r"] @ p["a2"]
    pred = first[c1] + second[c2]
    return np.einsum("ij,ij->i", pred, p["q"][w]) + p["b"][w] - normalisers[c2, c1]


# --- scoring -------------------------------------------------------------------


def partial_scores(docs: DataFrame, vocab: dict, flat: np.ndarray) -> DataFrame:
    """Scores without the words outside the head, which come as ``tail``."""
    head = {w: (vocab["ids"].get(w, 0), math.log(c + 1)) for w, c in vocab["head"].items() if w}
    mass = np.log(vocab["mass"].clip(1))
    end = math.log(vocab["ends"] + 1)
    shared = docs.sparkSession.sparkContext.broadcast((head, mass, flat, log_normalisers(flat)))
    names = ["doc_id", "held_out", "n_tokens", "n_head", "log_counts", "log_model", "tail"]

    def run(batches):
        head, mass, flat, normalisers = shared.value
        classes, none = Suffixes(), (-1, 0.0)
        for batch in batches:
            rows, codes, sizes = [], [], []
            for doc_id, out, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
                words = tokens(text)
                known = [head.get(w, none) for w in words]
                tail = [w for w, k in zip(words, known) if k[0] < 0]
                ids = [k[0] if k[0] > 0 else classes[w[-2:]] for w, k in zip(words, known)]
                log_counts = math.fsum(k[1] for k in known)
                own = math.fsum(k[1] for k in known if k[0] == 0)  # of class words in the head
                codes.append(codes_of(ids))
                sizes.append(len(ids) + 1)
                outputs = np.bincount(np.array(ids, np.int64), minlength=OUTPUTS)[FIRST_CLASS:]
                within = own - float(outputs @ mass)
                rows.append([doc_id, out, len(words) + 1, len(words) - len(tail), log_counts + end, within, [w.decode() for w in tail]])
                if sum(sizes) >= CHUNK:
                    yield batch_of(rows, codes, sizes, flat, normalisers)
                    rows, codes, sizes = [], [], []
            if rows:
                yield batch_of(rows, codes, sizes, flat, normalisers)

    def batch_of(rows, codes, sizes, flat, normalisers):
        logs = log_probabilities(flat, normalisers, np.concatenate(codes)).astype(np.float64)
        sums = np.add.reduceat(logs, np.r_[0, np.cumsum(sizes)[:-1]])
        columns = list(zip(*rows))
        columns[5] = np.array(columns[5]) + sums
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    source = spread(docs.select("doc_id", "text")).withColumn("held_out", held_out())
    return source.mapInArrow(
        run,
        "doc_id long, held_out boolean, n_tokens long, n_head long, log_counts double, log_model double, tail array<string>",
    )


def train_model(docs: DataFrame) -> tuple[DataFrame, dict, np.ndarray]:
    """Word counts, vocabulary and parameters, of the documents that are not held out."""
    training = docs.where(~held_out()).select("doc_id", "text")
    counts = written(word_counts(training), "word-counts")
    vocab = vocabulary(counts)
    flat = initial(noise_of(vocab["seen"]))
    for rate in ROUNDS:
        flat = train_round(training, flat, vocab, rate)
    return counts, vocab, flat


def score_documents(docs: DataFrame, model: tuple[DataFrame, dict, np.ndarray] | None = None) -> DataFrame:
    """Scores of all documents by ``model``, or by one trained on those that are not held out."""
    counts, vocab, flat = model or train_model(docs)
    partial = partial_scores(docs, vocab, flat).withColumn("row", F.monotonically_increasing_id())
    partial = written(partial, "partial-scores")
    tail = partial.select("row", F.explode("tail").alias("word")).join(counts, "word", "left")
    tail = tail.groupBy("row").agg(
        F.sum(F.log(F.coalesce("c", F.lit(0)) + 1.0)).alias("tail_log"), F.count("c").alias("tail_known")
    )
    total, distinct = vocab["total"], vocab["distinct"]
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    ends_known = int(vocab["ends"] > 0)
    ln10, norm = math.log(10), math.log(total + distinct + 1)
    return partial.drop("tail").join(tail, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("tail_known", F.lit(0)) + ends_known).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        ((F.col("log_counts") + tail_log - F.col("n_tokens") * norm) / ln10).alias("base_score"),
        ((F.col("log_model") + tail_log) / ln10).alias("score"),
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op1_lm_scoring": op1_lm_scoring}
