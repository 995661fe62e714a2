"""Operators over the table of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from ..functions.languages import label_of, language_of, tier_of

MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES = 25_000, 1_000_000, 40_000_000


def line_counts(content):
    """``(lines, sloc)``: lines of a text, and those that are not blank."""
    lines = F.split(content, "\n", -1)
    code = F.size(F.filter(lines, lambda x: F.regexp_replace(x, r"(?U)\s+", "") != ""))
    empty = content == ""
    return F.when(empty, 0).otherwise(F.size(lines)), F.when(empty, 0).otherwise(code)


def index_files(raw: DataFrame) -> DataFrame:
    """The file table of ``raw`` (path, content as text): counts, hash, flags.

    Content with a NUL in its first 8192 characters is binary and is left out.
    """
    path, content = F.col("path"), F.col("content")
    lines, sloc = line_counts(content)
    return raw.where(F.locate("\x00", F.substring(content, 1, 8192)) == 0).select(
        *raw.columns,
        paths.extension(path).alias("ext"),
        F.octet_length(content).cast("long").alias("size_bytes"),
        lines.alias("lines"),
        sloc.alias("sloc"),
        F.sha1(content.cast("binary")).alias("sha1"),
        paths.is_code(path).alias("is_code"),
        paths.is_test(path).alias("is_test"),
        (paths.is_generated(path) | paths.has_generated_header(content)).alias("is_generated"),
        paths.is_lockfile(path).alias("is_lockfile"),
    )


def walk_caps(
    files: DataFrame, path="path", size="size_bytes", repo="repo_id",
    max_files=MAX_FILES, max_file=MAX_FILE_BYTES, max_total=MAX_TOTAL_BYTES,
) -> DataFrame:
    """``files`` with ``status``: read, oversized or truncated.

    Oversized files are set aside first; the others are taken in path order
    until a cap of the repository is reached.  Repositories are independent
    window partitions, each bounded by the file list of one repository.
    """
    order = Window.partitionBy(repo, "_large").orderBy(path)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = files.withColumn("_large", F.col(size) > max_file)
    marked = marked.withColumn("_rank", F.row_number().over(order)).withColumn("_bytes", F.sum(size).over(running))
    status = (
        F.when(F.col("_large"), "oversized")
        .when((F.col("_rank") > max_files) | (F.col("_bytes") > max_total), "truncated")
        .otherwise("read")
    )
    return marked.withColumn("status", status).drop("_large", "_rank", "_bytes")


def language_profile(files: DataFrame, language="language", sloc="sloc") -> DataFrame:
    """Files, lines of code and share per language.

    The share's total is a one-row aggregate, so no window gathers all rows.
    """
    per = files.groupBy(language).agg(F.count("*").alias("files"), F.sum(sloc).alias("sloc"))
    total = per.agg(F.sum("sloc").alias("_total"))
    share = F.when(F.col("_total") > 0, F.col("sloc") / F.col("_total")).otherwise(0.0)
    return per.crossJoin(F.broadcast(total)).select(language, "files", "sloc", share.alias("share"))


def source_files(files: DataFrame) -> DataFrame:
    """Code that people wrote and that is no test."""
    p = F.col("path")
    return files.where(paths.is_code(p) & ~paths.is_generated(p) & ~paths.is_lockfile(p) & ~paths.is_test(p))


def languages(files: DataFrame) -> DataFrame:
    """``repo_id, language, label, tier, files, sloc, share, position`` of source files, by lines of code in each repository."""
    sources = source_files(files).select("repo_id", language_of(F.col("path")).alias("language"), line_counts(F.col("content"))[1].alias("sloc"))
    per = sources.groupBy("repo_id", "language").agg(F.count("*").alias("files"), F.sum("sloc").alias("sloc"))
    total = F.sum("sloc").over(Window.partitionBy("repo_id"))  # a row for each language
    share = F.when(total > 0, F.col("sloc") / total).otherwise(0.0)
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("sloc"), "language"))
    name = F.col("language")
    return per.select("repo_id", "language", label_of(name).alias("label"), tier_of(name).alias("tier"), "files", "sloc", share.alias("share"), place.alias("position"))


#: Structural languages whose tests and handlers are read like those of scripts, and the share that a language without a reader must pass.
DEEP, UNREAD_SHARE = ("python",), 0.05


def tier_warnings(files: DataFrame) -> DataFrame:
    """``repo_id, warning, languages``: which languages of a repository were read less than whole, the largest first.

    ``structural`` languages have no import graph and no frameworks, of
    ``shallow`` ones only copies and comments are read, and ``unparsed`` ones
    of more than a twentieth of all lines, with their percentage, not at all.
    """
    tier, name = F.col("tier"), F.col("language")
    warning = (
        F.when((tier == "structural") & name.isin(*DEEP), "structural").when(tier == "structural", "shallow")
        .when((tier == "history") & (F.col("share") > UNREAD_SHARE), "unparsed")
    )
    percent = F.floor(F.col("share") * 100 + 0.5).cast("string")
    said = F.when(tier == "history", F.concat("label", F.lit(" ("), percent, F.lit("%)"))).otherwise(F.col("label"))
    rows = languages(files).withColumn("warning", warning).where("warning IS NOT NULL")
    listed = F.array_sort(F.collect_list(F.struct("position", said.alias("said"))))
    return rows.groupBy("repo_id", "warning").agg(F.array_join(listed["said"], ", ").alias("languages"))


def duplicates(files: DataFrame, key="sha1", least: int = 2) -> DataFrame:
    return files.groupBy(key).agg(F.count("*").alias("copies")).where(F.col("copies") >= least)


def clone_shape(content):
    """Hash of a text with every word as ``$`` and every number as ``#``."""
    words = F.regexp_replace(F.regexp_replace(content, r"[0-9]+", "#"), r"[\p{L}_]+", r"\$")
    return F.sha1(F.regexp_replace(words, r"\s+", " ").cast("binary"))


def clone_families(files: DataFrame, shape="shape", path="path", weight="weight") -> DataFrame:
    """Groups of two or more equal shapes; the group's size, first member, rank value."""
    groups = files.groupBy(shape).agg(
        F.count("*").alias("members"), F.min(path).alias("first_member"), F.max(weight).alias("weight")
    )
    return groups.where("members >= 2").withColumn("volume", F.col("members") * F.col("weight"))


def convention_majority(files: DataFrame, dim="dim", choice="choice", ord_="ord") -> DataFrame:
    """Per dimension: the majority's choice (first seen wins a tie) and minority share."""
    per = files.groupBy(dim, choice).agg(F.count("*").alias("n"), F.min(ord_).alias("first_ord"))
    return per.groupBy(dim).agg(
        F.max_by(choice, F.struct(F.col("n"), -F.col("first_ord"))).alias("majority"),
        F.sum("n").alias("n_files"),
        (1 - F.max("n") / F.sum("n")).alias("minority"),
    )
