import random
import re
from collections import Counter
from zlib import crc32

import numpy as np

from ledgerlens.llm import pu_classifier, quality_rules
from ledgerlens.llm.features import repeat_words

from .helpers import documents, write_table

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=240):
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["ta", "re", "mi", "so", "lu"]) for _ in range(rng.randrange(1, 4))) for _ in range(80)]
        good = i % 4 != 0
        texts.append(" ".join(words if good else [w + "$$$" for w in words]))
        labels.append((i, int(good), 0))
    return texts, labels


def plain_repeat(words):
    times = Counter(zip(words, words[1:], words[2:]))
    return sum(
        any(times[tuple(words[j : j + 3])] > 1 for j in range(max(0, i - 2), i + 1) if j + 3 <= len(words))
        for i in range(len(words))
    )


def test_repeat_words_match_brute_force():
    rng = random.Random(2)
    for size in [0, 1, 2, 3, 4, 5, 30, 200]:
        for alphabet in (1, 2, 8, 500):
            words = [b"%d" % rng.randrange(alphabet) for _ in range(size)]
            assert repeat_words(words) == plain_repeat(words)


def test_base_statistics(spark):
    texts = ["a b\na b\n \n \nc", None, "", "é# \x0b|<x>", "x " * 60, " ".join(map(str, range(60)))]
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in quality_rules.judge(docs.selectExpr("*", "1 as kept"), None).collect()}
    assert [rows[0][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [5, 5, 0, 1, 0]
    assert rows[1].n_words == rows[2].n_words == 0 and rows[1].base_failed
    assert (rows[3].n_words, rows[3].word_chars, rows[3].n_symbols) == (2, 6, 4)
    assert rows[4].base_failed and not rows[4].kept and rows[5].kept


def test_statistics_match_brute_force(spark, tmp_path):
    """The query itself against one text at a time."""
    rng = random.Random(9)
    bits = ["ta", "re#", "é", "$x", "<|>", " ", " ", "\n", "\n", "\t", "\x0b", "\u00a0", "a b\n", "&"]
    texts = [None, "", " \n "] + ["".join(rng.choice(bits) for _ in range(rng.randrange(400))) for _ in range(60)]
    write_table(spark, tmp_path, "documents", documents(spark, texts).selectExpr("*", "1 as verdict", "2 as _judged"))
    folder = write_table(spark, tmp_path, "labels", spark.createDataFrame([(i, i % 2, 0) for i in range(40)], LABELS))
    rows = {r.doc_id: r for r in quality_rules.op5_quality_rules(spark, folder).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
        repeat = plain_repeat(words)
        want = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat)
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * repeat > 50 * len(words))
        assert r.kept == (not r.base_failed and r.quality_prob >= 0.5)


def test_pu_risk_matches_brute_force():
    """The gradient of the non-negative risk, by differences."""
    rng = np.random.default_rng(3)
    pos, unl, w = rng.normal(size=(20, 5)) + 1, rng.normal(size=(40, 5)), rng.normal(size=6)
    for prior in (0.1, 0.7):
        def risk(w):
            zp, zu = pos @ w[:-1] + w[-1], unl @ w[:-1] + w[-1]
            negative = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
            return prior * np.log1p(np.exp(-zp)).mean() + max(0.0, negative)
        fitted = pu_classifier.fit_nnpu(pos.astype(np.float32), unl.astype(np.float32), prior)
        assert risk(fitted) < min(risk(fitted + d) for d in 0.5 * np.vstack([np.eye(6), -np.eye(6)])) + 0.02
        assert risk(fitted) < risk(w)


def test_prior_of_known_mixtures():
    rng = np.random.default_rng(5)
    for prior in (0.2, 0.5, 0.85):
        for n_pos, n_unl in ((2000, 20000), (300, 2000)):
            n = int(prior * n_unl)
            pos, unl = rng.normal(2, 1, n_pos), np.concatenate([rng.normal(2, 1, n), rng.normal(-2, 1, n_unl - n)])
            counts = [np.bincount(pu_classifier.bins_of(z), minlength=pu_classifier.BINS) for z in (pos, unl)]
            assert abs(pu_classifier.estimate_prior(*counts) - prior) < 0.08
    none = np.zeros(pu_classifier.BINS)
    assert pu_classifier.estimate_prior(none, none) == 0.5


def test_pu_labels_of_0_change_nothing(spark):
    """Negatives are never read: the weights are those without them."""
    texts, labels = corpus(60)
    docs = documents(spark, texts)
    both, ones = (spark.createDataFrame([r for r in labels if r[1] >= least], LABELS) for least in (0, 1))
    assert np.allclose(pu_classifier.train(docs, both), pu_classifier.train(docs, ones), atol=1e-6)


def test_pu_sums_cover_all_unlabelled_rows(spark):
    """The pass against one text at a time, and a fit of few rows that it moves to the risk of all."""
    texts, labels = corpus(120)
    texts += [None, "", *texts[:3]]
    rng = np.random.default_rng(6)
    at, judges = rng.normal(size=4101), [rng.normal(size=4101) for _ in range(2)]
    docs = documents(spark, texts)
    rows = docs.select("text", pu_classifier.half().alias("half"))
    n, loss, gradient, scores = pu_classifier.unlabelled_sums(rows.repartition(3), at, judges)
    x = np.array([pu_classifier.vector(t) for t in texts], np.float64)
    z = x @ at[:-1] + at[-1]
    assert n == len(texts) and np.isclose(loss, np.log1p(np.exp(z)).sum())
    error = 1 / (1 + np.exp(-z))
    assert np.allclose(gradient, np.append(x.T @ error, error.sum()), atol=1e-4)
    own = np.array([r.half for r in rows.collect()])
    want = sum(np.bincount(pu_classifier.bins_of(x[own == k] @ judges[k][:-1] + judges[k][-1]), minlength=pu_classifier.BINS) for k in (0, 1))
    assert np.abs(scores - want).sum() <= 2  # a score at the border of two bins
    few = pu_classifier.train(docs, spark.createDataFrame(labels, LABELS), 30)
    predicted = x[:120] @ few[:-1] + few[-1] >= 0
    assert (predicted == [q for _, q, _ in labels]).mean() > 0.95


def test_rules_learn_and_filter(spark):
    texts, labels = corpus()
    docs = documents(spark, texts)
    lab = spark.createDataFrame(labels, LABELS)
    kept = {r.doc_id for r in quality_rules.filter_quality(docs.selectExpr("*", "2 as n_words"), lab).collect()}
    assert kept == {i for i, q, _ in labels if q}
    assert quality_rules.filter_quality(docs, lab).columns == docs.columns
    assert quality_rules.filter_quality(docs.limit(0), lab.limit(0)).count() == 0


def test_probabilities_are_calibrated():
    rng = np.random.default_rng(0)
    margin = rng.normal(size=4000) * 3
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * margin - 1)))).astype(float)
    a, b = quality_rules.fit_platt(margin, y)
    assert abs(a - 0.5) < 0.1 and abs(b + 1) < 0.2


def test_pu_held_out_accuracy_and_folds(spark, tmp_path):
    texts, labels = corpus()
    docs = documents(spark, [*texts, None, ""])
    write_table(spark, tmp_path, "documents", docs)
    # labels of the held-out fold are wrong on purpose: they must not matter
    wrong = [(i, 1 - q if crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    folder = write_table(spark, tmp_path, "labels", spark.createDataFrame(wrong, LABELS))
    rows = {r.doc_id: r for r in pu_classifier.op3_pu_quality(spark, folder).collect()}
    assert len(rows) == len(texts) + 2
    assert all(rows[i].held_out == (crc32(str(i).encode()) % 3 == 1) for i in rows)
    right = sum(rows[i].predicted == q for i, q, _ in labels if rows[i].held_out)
    assert right >= 0.95 * sum(rows[i].held_out for i, _, _ in labels)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())


def test_pu_without_positives(spark):
    docs = documents(spark, ["a b", None]).selectExpr("*", "1 as half", "2 as y")
    none = spark.createDataFrame([], LABELS)
    scored = pu_classifier.score_quality(docs, pu_classifier.train(docs, none)).collect()
    assert [r.score for r in scored] == [0.5, 0.5]
    ones = spark.createDataFrame([(0, 1, 0)], LABELS)
    assert pu_classifier.score_quality(docs.limit(0), pu_classifier.train(docs.limit(0), ones)).count() == 0
