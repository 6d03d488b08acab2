"""Listing and grouping of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skeinworks.functions.text import path_prefix


def bounded(value: int, low: int, high: int, name: str) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")
    return value


def list_files(files: DataFrame, prefix: str | None = None, pattern: str | None = None, limit: int = 100, path: str = "path", seq: str = "seq") -> DataFrame:
    """The first paths, in order, under a prefix (one leading slash is dropped) that hold a
    pattern; `total` counts all that match. Both filters run before anything is counted."""
    bounded(limit, 1, 500, "limit")
    found = files
    if prefix:
        found = found.where(F.startswith(F.col(path), F.lit(prefix.removeprefix("/"))))
    if pattern:
        found = found.where(F.contains(F.col(path), F.lit(pattern)))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(seq).limit(limit).crossJoin(total)  # one row


def group_by_folder(files: DataFrame, path: str, depth: int = 3, order: str | None = None) -> DataFrame:
    """folder (the first segments), n and the first path in order. Summed before the shuffle."""
    first = F.min_by(path, order) if order else F.min(path)
    return files.groupBy(path_prefix(path, depth).alias("folder")).agg(F.count("*").alias("n"), first.alias("first_path"))
