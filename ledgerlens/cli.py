"""``python -m ledgerlens.cli PATH``: audit a source tree.

Exit code 0: audited; 1: a score is at or above ``--fail-at``; 2: bad arguments.
"""

from __future__ import annotations

import argparse
import json
import os

from .functions.scalars import BANDS


def band_name(dimension: str, score: int) -> str:
    return next(name for start, name in BANDS[dimension] if score >= start)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerlens", description="Audit a source tree.")
    parser.add_argument("path")
    parser.add_argument("--log", help="commit log framed as sources.repository.parse_git_log reads it")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--fail-at", type=int, default=None, help="exit with 1 from this score on")
    args = parser.parse_args(argv)
    if not os.path.isdir(args.path):
        parser.error(f"{args.path} is no folder")

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans.audit import audit_scores
    from .sources.repository import commit_files, parse_git_log, read_tree

    spark = SparkSession.builder.appName("ledgerlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    files, commits, touches = read_tree(spark, os.path.abspath(args.path), "repository"), None, None
    if args.log:
        raw = spark.read.text(args.log, wholetext=True).select(F.lit("repository").alias("repo_id"), F.col("value").alias("raw"))
        commits = parse_git_log(raw)
        touches = commit_files(commits)
    rows = audit_scores(files, commits, touches).orderBy("dimension").collect()  # three rows
    out = [{**r.asDict(), "band": band_name(r["dimension"], r["score"])} for r in rows]
    if args.json:
        print(json.dumps(out))
    else:
        for r in out:
            print(f"{r['dimension']:<11}{r['score']:>4}  {r['band']:<13} confidence {r['confidence']}")
    return int(args.fail_at is not None and any(r["score"] >= args.fail_at for r in out))


if __name__ == "__main__":
    raise SystemExit(main())
