import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from ledgerlens.llm import lm_scoring as lm

from .helpers import documents


def fold(i):
    return i is not None and crc32(str(i).encode()) % 7 == 2


def corpus(n=160):
    rng = random.Random(14)
    texts = [None, "", " \n", "Unseen wörd", "A a\x0bB c"]
    for _ in range(n):
        kind = rng.choice(["en", "de"])
        texts.append(" ".join(kind + rng.choice("abcdefgh") + rng.choice(["", "", "X", "y"]) for _ in range(rng.randrange(1, 60))))
    return texts


def plain_base(texts, ids):
    toks = [[*(t or "").encode().lower().split(), b""] for t in texts]
    counts = Counter(w for own, i in zip(toks, ids) if not fold(i) for w in own)
    total, distinct = sum(counts.values()), len(counts)
    out = [
        (len(own), sum(counts[w] > 0 for w in own), sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own))
        for own in toks
    ]
    return total, out


@pytest.mark.parametrize("head", [lm.HEAD, 5, 1])
def test_base_columns_match_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    texts = corpus()
    ids = [*range(len(texts) - 1), None]
    docs = documents(spark, texts + texts[5:7], ids + ids[5:7]).selectExpr("*", "1 as row", "2 as word", "3 as c", "4 as tail")
    total, want = plain_base(texts + texts[5:7], ids + ids[5:7])
    rows = lm.score_documents(docs).collect()
    assert len(rows) == len(want)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    for i, (n, known, base) in zip(ids + ids[5:7], want):
        for r in by_id[i]:
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, fold(i))
            assert abs(r.base_score - base) < 1e-6 and r.score < 0 and math.isfinite(r.score)


def plain_score(text, counts, vocab, flat):
    """log10 probability of a text, one token at a time."""
    p, ids = lm.unpack(flat.astype(np.float64)), vocab["ids"]
    words = (text or "").encode().lower().split()
    outputs = [ids.get(w) or lm.class_of(w[-2:]) for w in words] + [lm.END]
    total, before = 0.0, [lm.START, lm.START]
    for n, out in enumerate(outputs):
        pred = p["r"][before[1]] @ p["a1"] + p["r"][before[0]] @ p["a2"]
        logits = p["q"] @ pred + p["b"]
        total += logits[out] - np.log(np.exp(logits).sum())
        if out >= lm.FIRST_CLASS:
            total += math.log((counts[words[n]] + 1) / vocab["mass"][out - lm.FIRST_CLASS])
        before = [before[1], out]
    return total / math.log(10)


@pytest.mark.parametrize("head", [lm.HEAD, 460])
def test_scores_match_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    rng = random.Random(5)
    texts = corpus(40) + [" ".join(f"w{rng.randrange(900)}" for _ in range(300)) for _ in range(6)]
    docs = documents(spark, texts)
    counts, vocab, flat = model = lm.train_model(docs)
    known = Counter({r.word.encode(): r.c for r in counts.collect()})
    for r in lm.score_documents(docs, model).collect():
        assert abs(r.score - plain_score(texts[r.doc_id], known, vocab, flat)) < 1e-3


def test_scores_do_not_depend_on_partitions(spark):
    docs = documents(spark, corpus(200))
    first, second = ({r.doc_id: r.score for r in lm.score_documents(docs.repartition(n)).collect()} for n in (4, 13))
    assert first == pytest.approx(second, rel=1e-9)


def test_model_beats_base_on_held_out_texts(spark):
    texts = corpus(600)
    rows = lm.score_documents(documents(spark, texts)).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_probabilities_sum_to_one():
    flat = lm.initial(lm.noise_of(np.arange(lm.OUTPUTS)), seed=3)
    z = lm.log_normalisers(flat)
    for c2, c1 in [(0, 0), (lm.START, lm.START), (3, 400)]:
        codes = (np.int64(c2) * (lm.OUTPUTS + 1) + c1) * lm.OUTPUTS + np.arange(lm.OUTPUTS)
        assert abs(np.exp(lm.log_probabilities(flat, z, codes)).sum() - 1) < 1e-4


def test_training_lowers_loss():
    rng = np.random.default_rng(0)
    seen = np.zeros(lm.OUTPUTS)
    seen[1:9] = 100
    ids = [int(x) for x in np.cumsum(rng.integers(1, 3, 20000)) % 8 + 1]
    codes, noise = lm.codes_of(ids), lm.noise_of(seen)
    flat = lm.initial(noise)
    trainer = lm.Trainer(flat, noise, 0.2, 1)
    for _ in range(20):
        trainer.learn(codes)
    before = lm.log_probabilities(flat, lm.log_normalisers(flat), codes).mean()
    after = lm.log_probabilities(trainer.flat, lm.log_normalisers(trainer.flat), codes).mean()
    assert after > before + 0.5


def test_class_masses_count_every_word(spark):
    rows = [("", 5), ("ab", 3), ("é", 2), ("x", 1), ("überraschung", 7)] + [(f"w{i}", 1) for i in range(600)]
    vocab = lm.vocabulary(spark.createDataFrame(rows, "word string, c long"))
    outside = [(w, c) for w, c in rows if w and w.encode() not in vocab["ids"]]
    want = np.ones(lm.CLASSES)
    for w, c in outside:
        want[lm.class_of(w.encode()[-2:]) - lm.FIRST_CLASS] += c + 1
    assert np.allclose(vocab["mass"], want) and len(vocab["ids"]) == lm.WORDS
    assert vocab["seen"].sum() == vocab["total"] == sum(c for _, c in rows)


def test_empty_table(spark):
    assert lm.score_documents(documents(spark, ["a"]).limit(0)).count() == 0
