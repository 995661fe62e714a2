"""From raw documents to packed sequences, in five stages.

Each stage works on everything its predecessor kept: quality rules drop
documents, line de-duplication drops lines, SimHash grouping keeps one document
of each group, decontamination drops documents, and packing returns the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm.decontaminate import remove_contaminated
from ledgerlens.llm.line_dedup import dedup_lines
from ledgerlens.llm.packing import default_tokenizer, pack
from ledgerlens.llm.quality_rules import filter_quality
from ledgerlens.llm.shared import discard, table, written
from ledgerlens.llm.simhash_dedup import keep_one_per_group


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs, short=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, default_tokenizer())


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Trained models, edit distances and a tokenizer are beyond SQL; the stages
#: are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; every stage but the last is written.

    A stage's rows are deleted when the next stage is written, so that one copy of the
    documents is held; the last stage reads those of its predecessor.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage-{number}")
            if before is not None:
                discard(before)
            before = docs
    return docs
