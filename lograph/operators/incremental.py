"""Incremental file work: size gate, result cache, remaining files, resume state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograph.fixed_values import FILE_SIZE_LIMIT
from lograph.functions.text import fingerprint, strip_text


def size_gate(files: DataFrame, limit: int = FILE_SIZE_LIMIT) -> DataFrame:
    """Files that are neither empty nor over the limit; the limit itself passes."""
    return files.where((F.col("length") > 0) & (F.col("length") <= limit))


def with_fingerprint(files: DataFrame, digits: int = 64) -> DataFrame:
    """``files``: path, length, modified_ms."""
    return files.withColumn("fingerprint", fingerprint(F.col("path"), F.col("length"), F.col("modified_ms"), digits))


def cache_split(files: DataFrame, results: DataFrame) -> DataFrame:
    """Files with their cached result, null when there is none: same fingerprint and same path."""
    cached = results.select("fingerprint", F.col("abs_path").alias("path"), F.col("result").alias("cached_result"))
    return files.join(cached, ["fingerprint", "path"], "left").withColumn("hit", F.col("cached_result").isNotNull())


def cache_misses(files: DataFrame, results: DataFrame) -> DataFrame:
    return files.join(
        results.where("result is not null").select("fingerprint", F.col("abs_path").alias("path")),
        ["fingerprint", "path"], "left_anti",
    )


def cache_rows(done: DataFrame) -> DataFrame:
    """Rows to add to the cache: trimmed results, blank ones left out. One row per path."""
    text = strip_text(F.col("result"))
    return done.where(F.length(text) > 0).select(
        "fingerprint", F.col("path").alias("abs_path"), F.substring_index("path", "/", -1).alias("file_name"),
        F.col("length").alias("file_size"), text.alias("result"),
    )


def combined_report(results: DataFrame) -> DataFrame:
    """Results as text blocks in file order, one row each; the sink puts the separator between them.

    ``results``: file_no, path, result.
    """
    return results.where("result is not null").select(
        "file_no", F.concat(F.lit("=== "), F.substring_index("path", "/", -1), F.lit(" ===\n"), "result").alias("block")
    )


def remaining_files(available: DataFrame, investigated: DataFrame, name: str = "file_name") -> DataFrame:
    """Available files that were not looked at yet."""
    return available.join(investigated.select(name), name, "left_anti")


def known_requests(requested: DataFrame, available: DataFrame, name: str = "file_name") -> DataFrame:
    """Requested files that exist; the others are dropped."""
    return requested.join(available.select(name), name, "left_semi")


def resume_state(states: DataFrame, keys: list[str]) -> DataFrame:
    """Latest state per investigation, only where it is not resolved."""
    rest = [c for c in states.columns if c not in keys]
    latest = states.groupBy(*keys).agg(F.max_by(F.struct(*rest), "iteration").alias("state"))
    return latest.select(*keys, *[F.col("state")[c].alias(c) for c in rest]).where("not is_resolved")


def next_state(states: DataFrame, succeeded: Column) -> DataFrame:
    """States after a run: resolved only when it succeeded, so that a failed run can resume."""
    return states.withColumns({"iteration": F.col("iteration") + 1, "is_resolved": succeeded})
