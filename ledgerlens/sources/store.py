"""Stored scan results and renderings of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
RESULT = (
    "schemaVersion int, repo struct<name:string,kind:string,branch:string,pushedAt:string>, "
    "scores array<struct<dimension:string,score:int,confidence:string>>, warnings array<string>"
)


def append_scans(scans: DataFrame, path: str) -> None:
    """Add scans to the store; server paths inside a result do not go with them."""
    clean = scans.withColumn("result", F.regexp_replace("result", r'"rootPath"\s*:\s*"[^"]*",?', ""))
    clean.write.mode("append").parquet(path)


def latest_scan(scans: DataFrame) -> DataFrame:
    """The newest scan of each slug that did not fail (struct maximum, one shuffle)."""
    rest = [c for c in scans.columns if c != "slug"]
    best = F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("_best")
    return scans.where("error IS NULL").groupBy("slug").agg(best).select("slug", "_best.*")


def examples(scans: DataFrame, limit: int) -> DataFrame:
    return scans.where("is_example").orderBy(F.desc("created_at"), "id").limit(limit)


def read_result(raw: Column) -> Column:
    """A stored result in today's shape; null if broken or from a newer version."""
    parsed = F.from_json(raw, RESULT)
    version = F.coalesce(parsed["schemaVersion"], F.lit(1))
    full = parsed.withField("schemaVersion", F.lit(SCHEMA_VERSION)).withField(
        "warnings", F.coalesce(parsed["warnings"], F.array().cast("array<string>"))
    )
    return F.when(parsed["repo"].isNotNull() & (version <= SCHEMA_VERSION), full)


def mermaid(nodes: DataFrame, edges: DataFrame) -> str:
    """Diagram text of a module graph, whose nodes are a dozen at most."""
    shown = nodes.orderBy(F.desc("files"), "path").collect()
    ids = {r["path"]: f"n{i}" for i, r in enumerate(shown)}
    kept = edges.where(F.col("from_dir").isin(*ids) & F.col("to_dir").isin(*ids)) if ids else edges.limit(0)
    links = kept.orderBy(F.desc("count"), "from_dir", "to_dir").collect()
    boxes = [f'  {ids[r["path"]]}["{r["path"]}<br/>{r["files"]} files"]' for r in shown]
    return "\n".join(["graph TD", *boxes, *[f"  {ids[r['from_dir']]} --> {ids[r['to_dir']]}" for r in links]])


def badge_columns(scores: DataFrame) -> DataFrame:
    """Text and colour of a badge per score row."""
    colour = F.when(F.col("score") >= 75, "#e05d44").when(F.col("score") >= 50, "#fe7d37").when(F.col("score") >= 25, "#dfb317").otherwise("#4c1")
    return scores.select("*", F.concat_ws(" ", "dimension", F.col("score").cast("string")).alias("label"), colour.alias("colour"))
