import array
import random
from zlib import crc32

import pytest
from tokenizers import Tokenizer

from ledgerlens.llm.packing import ENTRY, CAPACITY, Words, cut, default_tokenizer, encoder, pack, sequences

from .helpers import documents


def test_cut_covers_every_length():
    for length in range(1, 3 * CAPACITY + 5):
        pieces = cut(length)
        assert sum(p for p, _ in pieces) == length
        assert all(0 < p and p * k <= CAPACITY for p, k in pieces)
        assert all(p * k >= 0.96 * CAPACITY for p, k in pieces)


@pytest.fixture(scope="module")
def texts():
    long = "The quick brown fox's lowé 12 jumps! " * 1500
    sizes = [0, 1, 3, 50, 333, 2000, 4000]
    return [None, "", " \n", long, "<|endoftext|> a", " x y é", *[("ab Cd, " * n) for n in sizes], *["same text here"] * 40]


def test_pieces_round_trip(spark, texts):
    docs = documents(spark, texts).selectExpr("*", "1 as k", "2 as bucket", "3 as rank")
    rows = pack(docs.unionAll(docs.where("doc_id = 3")), default_tokenizer()).collect()
    plain = Tokenizer.from_file(default_tokenizer())
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    seen = {}
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert crc32(array.array("I", own).tobytes()) == r.ids_crc32
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, want in ids.items():
        times = 2 if i == 3 else 1
        assert sorted(p for s, n in seen[i] for p in range(s, s + n)) == sorted([*range(len(want))] * times)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(bins) == list(range(len(bins)))
    total = 0
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= CAPACITY
        total += at if at & (at - 1) == 0 else CAPACITY
    used = sum(r.length for r in rows)
    assert total - used < 0.02 * used + CAPACITY


def test_sequences_hold_the_ids(spark, texts):
    packed = pack(documents(spark, texts), default_tokenizer(), with_ids=True)
    rows = packed.collect()
    seqs = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    for r in rows:
        assert seqs[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert all(len(s) == CAPACITY or len(s) & (len(s) - 1) == 0 for s in seqs.values())


def test_words_are_encoded_like_whole_texts():
    rng = random.Random(13)
    parts = ["The", "é", "E\u0301", "İx", "\u0958", "ab", "12", "'s", "\u00a0", ".", ",!", "###", "(", "»", "日本", "x'S,", "<|endoftext|>", "<|ENDOFTEXT|>", "\x0c", "ß", "Σ"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    plain = Tokenizer.from_file(default_tokenizer())
    encode = encoder(default_tokenizer())
    for at in range(0, len(texts), 50):
        for text, ids in zip(texts[at : at + 50], encode(texts[at : at + 50])):
            assert array.array("I", ids).tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_memory_is_bounded():
    words = Words(limit=2 * ENTRY)
    for w in (b"a", b"b", b"c"):
        words.add(w, b"1")
    words.make_room()
    assert words.held == 0 and words.known(b"a") and b"a" in words.young and len(words.young) == 1
    assert not words.known(b"d")


def test_empty_table(spark):
    assert pack(documents(spark, ["a"]).limit(0), default_tokenizer()).count() == 0
