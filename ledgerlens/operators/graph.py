"""Links between files, and what follows from them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths


def normal_path(path):
    """Path without ``.`` parts and with ``..`` taken back."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc, p: F.when(
        p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    ).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def orphans(files: DataFrame, edges: DataFrame, path="path", source="from_path", target="to_path", keys: tuple = ()) -> DataFrame:
    """Files that no other file links to; ``keys`` such as ``repo_id`` keep repositories apart."""
    incoming = edges.where(F.col(source) != F.col(target)).select(*keys, F.col(target).alias(path)).distinct()
    return files.join(incoming, [*keys, path], "left_anti")


def roots(edges: DataFrame, source="from_path", target="to_path", keys: tuple = ()) -> DataFrame:
    """Nodes with outgoing links and none from another node."""
    out = edges.select(*keys, F.col(source).alias("node")).distinct()
    incoming = edges.where(F.col(source) != F.col(target)).select(*keys, F.col(target).alias("node")).distinct()
    return out.join(incoming, [*keys, "node"], "left_anti")


def module_nodes(files: DataFrame, directory="dir", least=2, most=12, keys: tuple = ()) -> DataFrame:
    """The largest directories of at least two files (a top-k report), of each repository if ``keys`` name it."""
    per = files.groupBy(*keys, F.col(directory).alias("path")).agg(F.count("*").alias("files")).where(F.col("files") >= least)
    if not keys:
        return per.orderBy(F.desc("files"), "path").limit(most)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("files"), "path"))
    return per.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def module_edges(edges: DataFrame, source="from_dir", target="to_dir", keys: tuple = ()) -> DataFrame:
    """Links between directories with their counts, without those inside one."""
    kept = edges.where(F.col(target).isNotNull() & (F.col(source) != F.col(target)))
    return kept.groupBy(*keys, source, target).agg(F.count("*").alias("count"))


def nearest_config(files: DataFrame, configs: DataFrame, path="path", config_dir="config_dir", keys: tuple = ()) -> DataFrame:
    """The deepest configured directory above each file, by equality joins.

    Every file gives its ancestor directories, so the prefix condition is a
    hash join on the directory and not a nested loop.
    """
    parts = F.split(paths.directory(F.col(path)), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ancestors = files.select(*keys, path, F.explode(F.array_distinct(above)).alias(config_dir))
    found = ancestors.join(configs.select(*keys, config_dir).distinct(), [*keys, config_dir])
    best = found.groupBy(*keys, path).agg(F.max_by(config_dir, paths.depth(F.col(config_dir))).alias(config_dir))
    return files.join(best, [*keys, path], "left")


def cut(df: DataFrame) -> DataFrame:
    """``df`` from the session's checkpoint folder, without the plan that made it.

    A local session that names no folder (a test) gets a temporary one; on a
    cluster executors would not share that, so it is an error there.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not getattr(spark, "_ledgerlens_checkpoints", None):
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all of {context.master} shares")
        spark._ledgerlens_checkpoints = tempfile.mkdtemp(prefix="ledgerlens-")
        atexit.register(shutil.rmtree, spark._ledgerlens_checkpoints, ignore_errors=True)
        context.setCheckpointDir(spark._ledgerlens_checkpoints)
    return df.checkpoint()


def fold_directories(counts: DataFrame, least: int = 3) -> DataFrame:
    """``path, target, files``: directories under ``least`` files fold upward.

    ``counts`` has a row (path, files) per directory; ``.`` is the root.  From
    the deepest level up, a directory with too few files, its folded children
    included, joins its parent.  One aggregation per level, however deep; the plan
    is cut every few levels.
    """
    level = paths.depth(F.when(F.col("path") == ".", "").otherwise(F.col("path")))
    cur = counts.select(F.col("path").alias("source"), F.col("path").alias("target"), "files")
    deepest = counts.agg(F.max(level)).head()[0] or 0
    for depth in range(deepest, 0, -1):
        here = F.size(F.split("target", "/")) == depth
        own = (F.col("target") != ".") & here
        total = F.sum("files").over(Window.partitionBy("target"))
        parent = paths.directory(F.col("target"))
        up = F.when(own & (total < least), F.when(parent == "", ".").otherwise(parent)).otherwise(F.col("target"))
        cur = cur.withColumn("target", up)
        if depth % 8 == 0:
            cur = cut(cur)
    sizes = cur.groupBy("target").agg(F.sum("files").alias("target_files"))
    return cur.join(sizes, "target").select(F.col("source").alias("path"), "target", "files", "target_files")


#: Rounds of a search whose rows are joined as they are before they become one table.
ROUNDS = 8


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``node, distance`` of all that is reachable, in fewest steps.

    With a column ``tag`` in ``starts``, such as the order and name of a root,
    also the least ``tag`` among the starts that reach a node in fewest steps: the
    one that a search from all starts at once, in the order of their tags, comes
    from.

    Breadth first until a round meets no new node: only nodes of the last round
    are joined, and nodes met before drop out by anti join.  Rounds are
    checkpointed, so lineage stays short, and every few of them become one
    table, so a round reads a few tables however deep the graph is.
    """
    tags = ["tag"] if "tag" in starts.columns else []
    least = [F.min(t).alias(t) for t in tags]
    once = lambda df: df.groupBy("node").agg(*least) if tags else df.select("node").distinct()
    seen = [once(starts).withColumn("distance", F.lit(0))]
    front = seen[0]
    for distance in count(1):
        known = reduce(DataFrame.unionByName, seen)
        step = once(front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), *tags))
        front = cut(step.join(known.select("node"), "node", "left_anti").withColumn("distance", F.lit(distance)))
        if front.isEmpty():
            return known.select("node", "distance", *tags)
        seen.append(front)
        if len(seen) > ROUNDS:
            seen = [cut(reduce(DataFrame.unionByName, seen))]
