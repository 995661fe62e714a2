"""Tokens that no head begins with are taken first and change nothing else."""

import random

from pyspark.sql import functions as F

from ledgerlens.operators import blocks

CORE = (blocks.LINE_COMMENT, blocks.BLOCK_COMMENT, blocks.QUOTED, blocks.TEMPLATE, blocks.REGEX)
BITS = ["async ", "function ", "catch (e) ", "{", "}", "(", ")", "<T>", " => ", "a", "$x", "#p", " ", "\n", ".", "?.", "'", "`", "/", "//", "/*", "*/", "=", "catch$", "async(x)=>{", "m(a) {", "[", "\\", "é"]


def test_plain_tokens_are_those_of_the_rest(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("".join(rng.choices(BITS, k=20)),) for _ in range(2000)], "c string")
    slow = "|".join((*CORE, blocks.CATCH, blocks.FUNCTION, blocks.ARROW, blocks.METHOD, blocks.REST))
    assert df.where(blocks.tokens_of(F.col("c"), blocks.SCRIPT) != blocks.tokens_of(F.col("c"), slow)).count() == 0
    assert blocks.SCRIPT.startswith(blocks.PLAIN)


def test_only_the_wanted_blocks_are_made(spark):
    files = spark.createDataFrame([("r", "a.ts", "function f() { try { g() } catch (e) { h() } }")], "repo_id string, path string, content string")
    found = blocks.braced(files, lambda kind: kind == "catch").collect()
    assert [(r.kind, r.head, r.body.strip(), r.line) for r in found] == [("catch", "catch (e) {", "h()", 1)]
