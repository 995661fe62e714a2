"""Harmonic packing of tokenised documents into fixed-length sequences.

A document's ids are cut into full sequences and a rest.  A rest of length r
belongs to the reciprocal class k with C/(k+1) < r <= C/k.  If k such pieces
fill a sequence of capacity C to ``FILL`` it is placed whole; otherwise a piece
of exactly C/(k+1) is cut off for class k+1 and what is left is classed anew
(two or three pieces a document).  Each bin of class k takes exactly k pieces,
so a piece's bin follows from its rank in the class alone: ranks are numbered
per (class, bucket) in parallel and shifted by the counts of earlier buckets.
The number of buckets grows with that of the pieces, so none outgrows a task,
and no task sees a class as a whole.  The fewer than k pieces that each class has
left are a bounded set, whatever the input (about 21,000 for C = 4096), and
are packed first-fit by falling length.

Defined cases: null or empty text is the end id alone; repeated rows are packed
as separate documents; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are not read.  A text of any length is cut whole, in
memory in proportion to it; what a task remembers of words is bounded in bytes.
"""

from __future__ import annotations

import array
import os
import unicodedata
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import spread, table, worker_store, written

CAPACITY, FILL, END_ID = 4096, 0.99, 2
#: Buckets that pieces are ranked in: at least so many, and one per so many pieces.
BUCKETS, PIECES_A_BUCKET = 64, 250_000
#: Bytes of words and their ids that a task remembers in each of two generations, and what an entry costs besides.
REMEMBERED, ENTRY = 24_000_000, 160
#: Texts are encoded together up to so many bytes, and new words of them so many at once.
BYTES_AT_ONCE, WORDS_AT_ONCE = 1_000_000, 200
CLOSING = b".,;:!?*$%&#|)"


def cut(length: int, capacity: int = CAPACITY, fill: float = FILL) -> list[tuple[int, int]]:
    """``(piece length, class)`` of a document's pieces, in order."""
    pieces = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if k * rest >= fill * capacity:
            pieces.append((rest, k))
            break
        pieces.append((capacity // (k + 1), k + 1))
        rest -= pieces[-1][0]
    return pieces


class Words:
    """Ids of words, remembered in two generations of bounded bytes.

    A full young generation becomes the old one; words met again move back, so
    frequent words stay.
    """

    def __init__(self, limit: int = REMEMBERED):
        self.young, self.old, self.limit, self.held = {}, {}, limit, 0

    def add(self, word: bytes, ids: bytes):
        self.young[word] = ids
        self.held += len(word) + len(ids) + ENTRY

    def known(self, word: bytes) -> bool:
        if word in self.young:
            return True
        ids = self.old.get(word)
        if ids is None:
            return False
        self.add(word, ids)
        return True

    def make_room(self):
        if self.held > self.limit:
            self.young, self.old, self.held = {}, self.young, 0


def encode_pieces(tokenizer, ends: frozenset, pieces: list[bytes]) -> dict[bytes, bytes]:
    """Ids of pieces without white space, little-endian uint32.

    Many words of letters are encoded as one text: the tokenizer cuts at white
    space and only the last id of a word carries a word end.
    """
    texts = [p.decode() for p in pieces]
    plain = [t.isalpha() and unicodedata.is_normalized("NFC", t) for t in texts]
    words = [p for p, ok in zip(pieces, plain) if ok]
    groups = [words[at : at + WORDS_AT_ONCE] for at in range(0, len(words), WORDS_AT_ONCE)]
    encoded = tokenizer.encode_batch([b" ".join(g).decode() for g in groups], add_special_tokens=False)
    out, alone = {}, [p for p, ok in zip(pieces, plain) if not ok]
    for group, e in zip(groups, encoded):
        ids = e.ids
        cuts = [i + 1 for i, x in enumerate(ids) if x in ends]
        if len(cuts) == len(group) and (not cuts or cuts[-1] == len(ids)):
            out.update((w, array.array("I", ids[a:b]).tobytes()) for w, a, b in zip(group, [0, *cuts], cuts))
        else:  # normalising has split a word
            alone += group
    for piece, e in zip(alone, tokenizer.encode_batch([p.decode() for p in alone], add_special_tokens=False)):
        out[piece] = array.array("I", e.ids).tobytes()
    return out


def encoder(path: str):
    """``f(texts) -> list of little-endian uint32 id strings``.

    The tokenizer lower-cases and cuts at white space, and a run of punctuation
    after a letter or digit is a token run of its own.  So a text's ids are
    those of its words in order, and a word's those of its core and its closing
    punctuation; each is encoded once while a task remembers it.  Texts with
    ``<|`` may hold a special token and are encoded whole.
    """
    store = worker_store()
    if ("tokenizer", path) not in store:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        ends = frozenset(i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>"))
        store["tokenizer", path] = tokenizer, ends
    tokenizer, ends = store["tokenizer", path]
    words = Words()  # of this task alone: nothing of it stays in a worker

    def encode(texts: list[str | None]) -> list[bytes]:
        words.make_room()
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        split = [t.lower().split() if b"<|" not in t else [] for t in raw]
        new = [w for w in set().union(*split).difference(words.young) if not words.known(w)]
        whole, parted = set(), {}
        for w in new:
            core = w.rstrip(CLOSING)
            if len(core) < len(w) and core[-1:].isalnum():
                parted[w] = core, w[len(core) :]
            else:
                whole.add(w)
        whole.update(*parted.values())
        pieces = [p for p in whole.difference(words.young) if not words.known(p)]
        young = words.young
        for word, ids in encode_pieces(tokenizer, ends, pieces).items():
            words.add(word, ids)
        for word, (core, closing) in parted.items():
            words.add(word, young[core] + young[closing])
        out = [b"".join(map(young.__getitem__, own)) for own in split]
        for i, t in enumerate(raw):
            if b"<|" in t:
                ids = tokenizer.encode(t.decode(), add_special_tokens=False).ids
                out[i] = array.array("I", ids).tobytes()
        return out

    return encode


def pieces_of(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """The documents' pieces, tokenised in Arrow batches."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k"] + ["ids"] * with_ids
    end = array.array("I", [END_ID]).tobytes()

    def rows_of(doc_ids, encoded):
        for doc_id, ids in zip(doc_ids, encoded):
            ids += end
            total, start = len(ids) // 4, 0
            for length, k in cut(total):
                own = ids[4 * start : 4 * (start + length)]
                row = (doc_id, start, length, crc32(own), total, k)
                yield (*row, array.array("I", own).tolist()) if with_ids else row
                start += length

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            rows, ids_held, texts, size = [], [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids_held.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= BYTES_AT_ONCE:
                    rows += rows_of(ids_held, encode(texts))
                    ids_held, texts, size = [], [], 0
            rows += rows_of(ids_held, encode(texts))
            if rows:
                types = [pa.int64()] * 5 + [pa.int32()] + [pa.list_(pa.int64())] * with_ids
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int" + ", ids array<long>" * with_ids
    return spread(docs.select("doc_id", "text")).mapInArrow(run, schema)


def first_fit(pieces: pd.DataFrame) -> pd.DataFrame:
    """Bins by falling length; equal lengths keep the order of doc_id and start."""
    pieces = pieces.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
    room, bins = [], []
    for length in pieces["length"]:
        at = next((i for i, r in enumerate(room) if r >= length), len(room))
        if at == len(room):
            room.append(CAPACITY)
        room[at] -= length
        bins.append(at)
    return pieces.assign(bin=bins)


def pack(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """One row per piece, with its sequence and its place there."""
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    pieces = written(pieces_of(docs, tokenizer_path, with_ids), "pieces")
    buckets = max(BUCKETS, pieces.count() // PIECES_A_BUCKET)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))

    counts = pieces.groupBy("k", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    in_class = Window.partitionBy("k")
    counts = counts.select(
        "k",
        "bucket",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"),
        F.floor(F.sum("n").over(in_class) / F.col("k")).alias("bins"),
    )
    # at most one row for each of the classes, of which there are 2 * sqrt(C)
    classes = counts.groupBy("k").agg(F.first("bins").alias("bins"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("k", F.coalesce(F.sum("bins").over(earlier), F.lit(0)).alias("base"))
    places = written(counts.join(F.broadcast(classes), "k"), "places")

    local = Window.partitionBy("k", "bucket").orderBy("doc_id", "start", "ids_crc32", "length")
    ranked = (
        pieces.withColumn("local", F.row_number().over(local) - 1)
        .join(places, ["k", "bucket"])  # dealt by these columns already
        .withColumn("rank", F.col("ahead") + F.col("local"))
        .withColumn("full", F.col("rank") < F.col("bins") * F.col("k"))
    )
    filled = ranked.where("full").withColumn("sequence_id", F.col("base") + F.floor(F.col("rank") / F.col("k")))

    next_id = places.agg(F.max(F.col("base") + F.col("bins")).alias("next_id"))
    rest = ranked.where("not full").select(*keep, "k", "rank")
    types = ", ".join(f"{c} {t}" for c, t in rest.dtypes)
    rest = rest.groupBy().applyInPandas(first_fit, f"{types}, bin long")
    rest = rest.crossJoin(F.broadcast(next_id)).withColumn("sequence_id", F.col("next_id") + F.col("bin"))

    both = filled.select(*keep, "k", "rank", "sequence_id").unionByName(rest.select(*keep, "k", "rank", "sequence_id"))
    ahead = Window.partitionBy("sequence_id").orderBy("k", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).select(*keep, "sequence_id", "offset")


def sequences(packed: DataFrame, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids`` of pieces packed with their ids.

    Padded to the capacity, except where the length is a power of two.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    short = F.when(F.bit_count(F.size("ids")) == 1, 0).otherwise(CAPACITY - F.size("ids"))
    return whole.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id).cast("long"), short)).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op6_harmonic_packing": op6_harmonic_packing}
