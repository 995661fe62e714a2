import hashlib
import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from ledgerlens.llm.secret_scan import find_secrets, op9_secret_scan, window_entropy

from .helpers import documents, write_table

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PLAIN = {
    "assign": (re.compile(ASSIGN, re.IGNORECASE | re.ASCII), lambda m: len(m[2]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def plain(text):
    out = []
    for n, (pattern, ok) in enumerate(PLAIN.values()):
        out += [(m.start(), n, m.end()) for m in pattern.finditer(text or "") if ok(m)]
    return sorted(out)


def texts():
    rng = random.Random(6)
    bits = ["token", "Secret", "API_KEY", "apikey", ":", "=", " ", '"', "'", "AKIA", "A1B2C3D4E5F6G7H8", "é😀", "\x01", "\x02"]
    bits += ["0123456789abcdef01234567", "abc", "\n", "passwd=", "x.y-z", "AKIAAKIA", "0123456789abcdef"]
    return [
        None,
        "",
        'é token = "5f367f08b1a810c7777ad785b0be42018bfcbf49" end',
        "key wJalrXUtnFEMI7K9MDENGbPxRfiCYzQ81aa here",
        "id 123e4567-e89b-12d3-a456-426614174000 and some-long-hyphenated-name-2024 and /usr/share/python3/dist-packages",
        "x" * 30 + " " + "zb1" * 12,
        *["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(150)],
    ]


def test_base_spans_match_plain_patterns(spark, tmp_path):
    all_texts = texts()
    docs = documents(spark, all_texts).selectExpr("*", "1 as clean", "2 as base", "3 as spans")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in find_secrets(docs).collect()}
    for i, t in enumerate(all_texts):
        assert [s for s in got[i] if s[1] < 3] == plain(t), t
    assert [s[1] for s in got[2]] == [0, 2]
    assert [s[1] for s in got[3]] == [3]
    assert got[4] == [] and got[5] == []
    write_table(spark, tmp_path, "documents", docs)
    for r in op9_secret_scan(spark, str(tmp_path)).collect():
        text = ",".join(f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in plain(all_texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert find_secrets(docs.limit(0)).count() == 0


def test_window_entropy_matches_recount(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdef0123+/=Z") for _ in range(rng.randrange(20, 60))) for _ in range(40)] + ["a" * 25]

    def plain_top(s):
        tops = []
        for i in range(len(s) - 19):
            counts = Counter(s[i : i + 20])
            tops.append(-sum(c / 20 * math.log2(c / 20) for c in counts.values()))
        return max(tops)

    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", window_entropy(F.col("w")).alias("h")).collect()
    assert all(abs(r.h - plain_top(r.w)) < 1e-9 for r in rows)


def test_very_many_matches_in_one_text(spark):
    """Hex runs without number, in a text of one megabyte."""
    rng = random.Random(7)
    text = " ".join("é" * rng.randrange(3) + "%032x" % rng.getrandbits(128) for _ in range(30_000))
    began = time.time()
    [row] = find_secrets(documents(spark, [text])).collect()
    assert [tuple(s) for s in row.spans if s.kind < 3] == plain(text)
    assert time.time() - began < 40
