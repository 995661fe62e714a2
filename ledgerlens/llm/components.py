"""Connected components of an edge list, without collecting any of it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

#: So many edges are contracted at once.
EDGES_AT_ONCE = 1 << 19


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the smallest of its component, and that smallest one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, up = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while (apart := up[a] != up[b]).any():
        a, b = a[apart], b[apart]
        x, y = up[a], up[b]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while ((further := up[up]) != up).any():
            up = further
    leaves = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[leaves], nodes[up[leaves]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges ``hi, lo`` (longs) of the same components, fewer and shallower: each portion of a task becomes stars."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("hi", "lo")])
            size += batch.num_rows
            if size >= EDGES_AT_ONCE:
                yield portion(held)
                held, size = [], 0
        if size:
            yield portion(held)

    def portion(held):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in stars(*(np.concatenate(c) for c in zip(*held)))], names=["hi", "lo"])

    return edges.mapInArrow(run, "hi long, lo long")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionAll(
        edges.select(F.col("lo").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("root"))
    )
    per_node = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return per_node.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("root") > 0))).isEmpty()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has an edge to another node.

    ``root`` is the smallest node of the component; roots themselves have no
    row.  Nodes are longs.  Every task first makes stars of its own edges; then it
    alternates large-star and small-star contractions (logarithmically many
    rounds in practice).  Minima are partially aggregated before each
    shuffle and AQE splits a hub's rows in the joins, so a node with very many
    neighbours is no bottleneck.  Every round is written to the shared folder.
    """
    hi, lo = F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo")
    cur = written(contracted(edges.where(F.col(left) != F.col(right)).select(hi, lo)).distinct(), "edges")
    while not _is_forest_of_stars(cur):
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            cur.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = written(large, "large-star")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi")
        small = (
            small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionAll(low.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        before, cur = cur, written(small, "small-star")
        discard(before, large)
    out = cur.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    out.written_to = cur.written_to  # for discard()
    return out
