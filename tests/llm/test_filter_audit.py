"""op13: counters of all orders against a brute force over documents."""

import re
from collections import Counter
from itertools import permutations

import pytest

from ledgerlens.llm.filter_audit import BIT, audit_filters, failure_counts, marks
from tests.llm.helpers import DOCS, documents

LABELS = "doc_id long, quality int, toxic int"
LONG = " ".join(f"word{i}" for i in range(120))


def masks(rows):
    """``(part, set of failed filters)`` of each row."""
    out = []
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = set()
        failed |= {"A"} if len(words) < 100 else set()
        failed |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        failed |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        failed |= {"D"} if re.search("[#$%&*|]", t) else set()
        failed |= {"E"} if any((o[1] or "") == t and None not in (o[0], doc_id) and o[0] < doc_id for o in rows) else set()
        out.append((lang or "", failed))
    return out


def brute(rows, good, toxic):
    judged = masks(rows)
    out = {}
    for order in permutations("ABCDE"):
        for step in range(1, 6):
            own, before = order[step - 1], set(order[: step - 1])
            for part in {p for p, _ in judged}:
                c = Counter(kept=0, removed=0, redundant=0, unique_fails=0, good_lost=0, toxic_lost=0, shapley=0)
                for row, (p, failed) in zip(rows, judged):
                    if p != part:
                        continue
                    hit, gone = own in failed, bool(failed & before)
                    c["kept"] += not hit and not gone
                    c["removed"] += hit and not gone
                    c["redundant"] += hit and gone
                    c["unique_fails"] += failed == {own}
                    c["good_lost"] += hit and not gone and row[0] in good
                    c["toxic_lost"] += hit and not gone and row[0] in toxic
                    c["shapley"] += sum(next(x for x in o if x in failed) == own for o in permutations("ABCDE")) if hit else 0
                out[part, "".join(order), step] = dict(c)
    return out


def rows_of(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): {n: r[n] for n in names} for r in df.collect()}


ROWS = [
    (5, LONG, "en"), (3, LONG, "de"), (9, LONG, "en"), (9, LONG, "en"), (3, LONG, "en"),  # 3 twice: neither is a copy
    (1, None, "en"), (2, "", None), (None, "", "en"), (None, LONG, "en"),
    (20, "A " * 150, "en"), (21, "WORD $ " * 60, "fr"), (22, LONG + " #", "fr"), (23, LONG.upper(), "en"), (24, "\t\x0b \n", "en"),
    (25, "é " * 99 + "é", "en"), (26, LONG + "|", "en"), (4, LONG + "|", "en"),
]


def test_against_brute_force(spark):
    rows = [(*r, "s", 0) for r in ROWS]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (9, 1, None), (22, None, 1), (20, 0, 1), (77, 1, 1)], LABELS)
    assert rows_of(audit_filters(docs, labels)) == brute(rows, {5, 9}, {5, 22, 20})


@pytest.mark.parametrize("partitions", [1, 3, 37])
def test_runs_of_copies_cross_partitions(spark, partitions):
    # AQE would put the small partitions together again
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        texts = [LONG] * 300 + [f"{LONG} {i % 20}" for i in range(200)] + ["x"] * 7
        ids = [(i * 7919) % 100_003 for i in range(len(texts))]
        docs = documents(spark, texts, ids).repartition(9)
        counts = failure_counts(docs, spark.createDataFrame([], LABELS))
        got = Counter()
        for r in counts.collect():
            got[r.mask] += r.n
        assert got == {0: 21, BIT["E"]: 479, BIT["A"]: 1, BIT["A"] | BIT["E"]: 6}
        places = {r.place for r in marks(docs).where("edge IS NULL AND part = 'en'").select("place").distinct().collect()}
        assert len(places) > (partitions > 1)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_empty_table_and_clashing_columns(spark):
    labels = spark.createDataFrame([(1, 1, 1)], LABELS)
    assert audit_filters(documents(spark, []), labels).count() == 0
    odd = documents(spark, [LONG, LONG + " $"]).selectExpr("*", "1 AS mask", "2 AS part", "3 AS edge", "4 AS place", "5 AS n", "6 AS quality", "7 AS `print`")
    got = rows_of(audit_filters(odd, labels))
    assert len(got) == 600 and got["en", "DABCE", 1] == {"kept": 1, "removed": 1, "redundant": 0, "unique_fails": 1, "good_lost": 1, "toxic_lost": 1, "shapley": 120}


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(200_000))
    counts = failure_counts(documents(spark, [text, text]), spark.createDataFrame([], LABELS))
    assert sorted((r.mask, r.n) for r in counts.collect()) == [(0, 1), (BIT["E"], 1)]
