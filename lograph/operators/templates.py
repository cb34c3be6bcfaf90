"""Templates mined from log lines by a prefix tree of fixed depth.

A line's masked tokens lead to a leaf: first their number, then the first ``depth`` of them. In a leaf a position keeps its token if
all lines agree on it, and is a wildcard otherwise. Agreement is the least and the greatest token being one, so leaves are built per
task and merged in any order: the same lines give the same templates however they are dealt.

Lines fold to distinct masked lines before their tokens are looked at, and tokens fold per leaf and position before they are shuffled, so a
template that a third of all lines share sends few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograph.operators.findings import line_severity, template

DEPTH, ANY = 3, "<*>"


def tokens(line: Column) -> Column:
    """Masked tokens of a line; none for an empty or null line."""
    return F.array_remove(F.split(F.coalesce(template(line), F.lit("")), r"\s+"), "")


def leaf(found: Column, depth: int = DEPTH) -> Column:
    """The id of the leaf that tokens lead to."""
    return F.md5(F.to_json(F.struct(F.size(found).alias("n"), F.slice(found, 1, depth).alias("head"))))


def mined_templates(lines: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``template_id``, ``template``, ``n_tokens``, ``wildcards``, ``variants`` (distinct masked lines), ``lines``, ``files``, and lines by severity.

    ``lines``: file_name, line. Every line is in one template.
    """
    severity = line_severity(F.col("line"))
    masked = lines.select("file_name", tokens(F.col("line")).alias("tokens"), severity.alias("severity"))
    folded = masked.groupBy("tokens", "file_name").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("severity").isin("error", "critical")).alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    kinds = folded.groupBy("tokens").agg(F.sum("lines").alias("lines"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"))
    kinds = kinds.withColumn("template_id", leaf(F.col("tokens"), depth))
    counts = kinds.groupBy("template_id").agg(
        F.count(F.lit(1)).alias("variants"), F.sum("lines").alias("lines"), F.sum("errors").alias("error_lines"), F.sum("warnings").alias("warning_lines"))
    places = kinds.select("template_id", F.posexplode("tokens").alias("pos", "token"))
    agreed = places.groupBy("template_id", "pos").agg(F.min("token").alias("low"), F.max("token").alias("high"))
    words = agreed.groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(ANY).alias("word")))).alias("words"))
    files = folded.select(leaf(F.col("tokens"), depth).alias("template_id"), "file_name").distinct().groupBy("template_id").agg(F.count(F.lit(1)).alias("files"))
    word = F.coalesce(F.transform("words", lambda w: w["word"]), F.expr("cast(array() as array<string>)"))
    return counts.join(words, "template_id", "left").join(files, "template_id").select(
        "template_id", F.array_join(word, " ").alias("template"), F.size(word).cast("bigint").alias("n_tokens"),
        F.size(F.filter(word, lambda w: w == ANY)).cast("bigint").alias("wildcards"), "variants", "lines", "files", "error_lines", "warning_lines")


def with_template(lines: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Lines with the ``template_id`` of their leaf, which depends on the line alone."""
    return lines.withColumn("template_id", leaf(tokens(F.col("line")), depth))


def template_digest(lines: DataFrame, mined: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Templates per file with how many lines each covers: file_name, template, lines. ``mined`` may come from other lines than these."""
    counted = with_template(lines, depth).groupBy("file_name", "template_id").agg(F.count(F.lit(1)).alias("lines"))
    return counted.join(mined.select("template_id", "template"), "template_id", "left").select("file_name", "template_id", "template", "lines")
