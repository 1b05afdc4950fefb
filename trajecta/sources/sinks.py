"""Sinks: JSON lines and Parquet in input order, split windows, routed logs and resumable results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import not_done
from ..operators.selection import hash_split


def conversations(converted: DataFrame, path: str, single: bool = False) -> None:
    """Kept conversations as JSON lines in source order; ``single`` writes one file."""
    kept = converted.where("reason is null").select("ordinal", "conversation.*").orderBy("ordinal").drop("ordinal")
    (kept.coalesce(1) if single else kept).write.mode("overwrite").json(path, ignoreNullFields=False)


def curation(scores: DataFrame, kept: DataFrame, summary: dict, path: str) -> None:
    """kept, scores and summary below a path; give tables that are written or cached, as each is read once more."""
    kept.orderBy("ordinal").write.mode("overwrite").json(f"{path}/kept")
    scores.orderBy("ordinal").write.mode("overwrite").json(f"{path}/scores")
    scores.sparkSession.createDataFrame([(json.dumps(summary, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")


def windows(rows: DataFrame, path: str, fraction: float = 0.02) -> None:
    """Windows below split=train and split=valid, by the hash of their instance."""
    hash_split(rows, "instance_id", fraction).write.mode("overwrite").partitionBy("split").json(path)


def routed_log(classified: DataFrame, path: str, mode: str = "append") -> None:
    """summary, full and suspect rows of a classified request log (see streaming.log_stream.classified)."""
    classified.select("t", "status", "n_messages", "malformed_names", "unparsed", F.substring(F.coalesce("raw", F.lit("")), -600, 600).alias("raw_tail"), "error").write.mode(mode).json(f"{path}/summary")
    classified.select("t", "status", "body", "raw", "error").write.mode(mode).json(f"{path}/full")
    classified.where("suspicious").select("t", "body", F.substring(F.coalesce("raw", F.lit("")), -4000, 4000).alias("raw")).write.mode(mode).json(f"{path}/suspect")


def append_new(results: DataFrame, path: str, key: str) -> int:
    """Appends the results whose key is not stored yet, and returns how many; a path without results counts as empty."""
    spark = results.sparkSession
    try:
        new = not_done(results, spark.read.schema(results.schema).parquet(path), key)
    except Exception as why:  # only a path that is not there is no results
        if "PATH_NOT_FOUND" not in str(why):
            raise
        new = results
    new = new.persist()
    try:
        n = new.count()
        new.write.mode("append").parquet(path)
    finally:
        new.unpersist()
    return n


def by_adapter(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("adapter").json(path)
