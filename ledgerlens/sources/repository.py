"""Source trees and commit logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.files import index_files, walk_caps


def read_tree(spark: SparkSession, root: str, repo_id: str, **caps) -> DataFrame:
    """The indexed files of a source tree, with the walk's caps applied.

    Paths are relative to ``root``.  The caps are applied to paths and lengths
    alone; contents are read for the files that they leave, which the cap on the
    number of files bounds.  Bytes that are no UTF-8 become U+FFFD.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inner = F.regexp_extract("path", "^(?:[a-z]+:/*)?/?(.*)$", 1)
    base = root.split(":", 1)[-1].strip("/")
    relative = F.substring(inner, F.lit(len(base) + 2), F.length(inner))
    files = raw.select(F.lit(repo_id).alias("repo_id"), relative.alias("path"), F.col("length").alias("size_bytes"))
    files = files.where(paths.is_relevant(F.col("path")) & ~F.col("path").startswith(".git/"))
    kept = walk_caps(files, **caps).where("status = 'read'").select("repo_id", "path")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    contents = raw.select(relative.alias("path"), text.alias("content"))
    return index_files(contents.join(F.broadcast(kept), "path").select("repo_id", "path", "content"))


def read_git_logs(spark: SparkSession, path: str) -> DataFrame:
    """``repo_id, raw, place`` of logs on disk, one row per record; a log's file is named by its repository.

    The text source cuts at the zero bytes that frame records, so a log of any
    size is read by as many tasks as it has splits, and no row holds more than one record.
    ``place`` is where a record stands: its split, then its row there.
    """
    rows = spark.read.option("lineSep", "\x00").text(path).where(F.locate("\x1e", F.col("value")) > 0)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("repo_id"), F.col("value").alias("raw"), place.alias("place"))


def parse_git_log(logs: DataFrame, raw: str = "raw", keys=("repo_id",)) -> DataFrame:
    """Commits of ``git log`` output framed by NUL, US and RS, newest first.

    Header fields: sha, name, address, seconds, subject, body; then one line
    per file with added and deleted counts (``-`` for binary is 0).  Malformed
    records are skipped.  A row of ``logs`` may hold a whole log or, with its
    ``place`` among ``keys``, one record of ``read_git_logs``.
    """
    chunks = logs.select(*keys, F.posexplode(F.split(raw, "\\x00")).alias("ord", "_chunk")).where(F.locate("\x1e", F.col("_chunk")) > 0)
    head = F.split(F.substring_index("_chunk", "\x1e", 1), "\x1f")
    stat = F.split(F.expr("substring(_chunk, locate('\x1e', _chunk) + 1)"), "\n")
    cells = F.transform(stat, lambda s: F.split(F.regexp_replace(s, r"^\s+|\s+$", ""), "\t"))
    cells = F.filter(cells, lambda c: F.size(c) >= 3)
    number = lambda c: F.coalesce(F.regexp_extract(c, r"^(\d+)", 1).try_cast("long"), F.lit(0))
    files = F.transform(
        cells,
        lambda c: F.struct(paths.normalised(F.get(c, F.lit(2))).alias("path"), number(F.get(c, F.lit(0))).alias("added"), number(F.get(c, F.lit(1))).alias("deleted")),
    )
    rows = chunks.withColumn("_head", head).where(F.size("_head") >= 6).withColumn("files", files)
    total = lambda f: F.aggregate(F.col("files"), F.lit(0).cast("long"), f)
    field = lambda i: F.get("_head", F.lit(i))
    return rows.select(
        *keys,
        "ord",
        field(0).alias("sha"),
        field(1).alias("author_name"),
        field(2).alias("author_email"),
        F.timestamp_seconds(F.coalesce(field(3).try_cast("long"), F.lit(0))).alias("ts"),
        field(4).alias("subject"),
        field(5).alias("body"),
        "files",
        total(lambda acc, f: acc + f["added"] + f["deleted"]).alias("churn"),
        total(lambda acc, f: acc + f["added"]).alias("lines_added"),
    )


def commit_files(commits: DataFrame, keys=("repo_id",)) -> DataFrame:
    return commits.select(*keys, "sha", F.explode("files").alias("f")).select(*keys, "sha", "f.*")


def repo_slug(text: Column) -> Column:
    """``owner/name`` of an address or shorthand, null if it is none."""
    plain = F.regexp_replace(F.trim(text), r"^git\+", "")
    plain = F.regexp_replace(plain, r"^https?://", "")
    plain = F.regexp_replace(plain, r"^git@github\.com:", "")
    plain = F.regexp_replace(plain, r"^www\.", "")
    plain = F.regexp_replace(plain, r"^github\.com/", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\.git$", ""), r"/+$", "")
    parts = F.filter(F.split(plain, "/"), lambda p: p != "")
    slug = F.concat(F.get(parts, F.lit(0)), F.lit("/"), F.get(F.split(F.get(parts, F.lit(1)), "[?#]"), F.lit(0)))
    return F.when(slug.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$") & ~slug.contains(".."), slug)


def repo_branch(text: Column) -> Column:
    """Branch of a ``/tree/<branch>`` address, null without one."""
    plain = F.get(F.split(F.trim(text), "[?#]"), F.lit(0))
    branch = F.regexp_replace(F.regexp_extract(plain, "/tree/(.+)$", 1), "/+$", "")
    return F.when(branch != "", branch)
