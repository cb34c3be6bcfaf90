"""Resource identifiers: Column in, Column out."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lograph.fixed_values import (
    ARN_PATTERN, DEFAULT_REGION, DEFAULT_RELATIONSHIP, RELATIONSHIP_WORDS, UNKNOWN,
)


def find_arns(text: Column) -> Column:
    """All identifiers in a line, in order."""
    return F.regexp_extract_all(text, F.lit(ARN_PATTERN), F.lit(0))


def normalize_arn(arn: Column) -> Column:
    """A bucket identifier loses its path, any other stays as it is."""
    bucket = F.lit("arn:aws:s3:::")
    path = F.substring(arn, 14, 2147483647)
    return F.when(F.startswith(arn, bucket), F.concat(bucket, F.substring_index(path, "/", 1))).otherwise(arn)


def normalize_arns(arns: Column) -> Column:
    """Normalised identifiers, distinct, in the order they first appear."""
    return F.array_distinct(F.transform(F.array_compact(arns), normalize_arn))


def _parts(arn: Column) -> Column:
    return F.split(arn, ":", -1)


def resource_type(arn: Column) -> Column:
    """``service:resource``; ``unknown`` below six parts."""
    parts = _parts(arn)
    return F.when(
        F.size(parts) >= 6,
        F.concat(F.get(parts, F.lit(2)), F.lit(":"), F.substring_index(F.get(parts, F.lit(5)), "/", 1)),
    ).otherwise(F.lit(UNKNOWN))


def service(arn: Column) -> Column:
    return F.substring_index(resource_type(arn), ":", 1)


def resource_name(arn: Column) -> Column:
    """Last non-empty path segment of the last part; the whole identifier below six parts."""
    whole = normalize_arn(arn)
    tail = F.substring_index(whole, ":", -1)
    segments = F.filter(F.split(tail, "/", -1), lambda s: s != "")
    return F.when(F.size(_parts(whole)) < 6, whole).otherwise(F.coalesce(F.try_element_at(segments, F.lit(-1)), tail))


def region(arn: Column) -> Column:
    return F.coalesce(F.nullif(F.get(_parts(arn), F.lit(3)), F.lit("")), F.lit(DEFAULT_REGION))


def last_part(arn: Column) -> Column:
    return F.substring_index(arn, ":", -1)


def relationship(message: Column) -> Column:
    """Label of an edge from plain substrings of the message; the first label that fits wins."""
    text = F.lower(message)
    label = None
    for name, words in RELATIONSHIP_WORDS:
        fits = reduce(or_, [F.contains(text, F.lit(word)) for word in words])
        label = F.when(fits, name) if label is None else label.when(fits, name)
    return label.otherwise(DEFAULT_RELATIONSHIP)


def reference_id(source_type: Column, identifier: Column, key: Column) -> Column:
    """``type:identifier:key``; null when any part is null."""
    return F.concat(source_type, F.lit(":"), identifier, F.lit(":"), key)


def safe_name(name: Column) -> Column:
    """A name fit for a file or a graph id. Two ids may share one; see ``ledger.name_collisions``."""
    return F.translate(name, ":/", "__")


def bucket_of(identifier: Column) -> Column:
    """Bucket of ``s3://bucket/prefix`` or of a plain bucket name."""
    return F.substring_index(F.regexp_replace(identifier, "^s3://", ""), "/", 1)


def prefix_of(identifier: Column, prefix: Column) -> Column:
    """Key prefix inside the identifier; only without one does the separate prefix count."""
    bare = F.regexp_replace(identifier, "^s3://", "")
    at = F.instr(bare, "/")
    return F.when(at > 0, F.substring(bare, at + 1, F.length(bare))).otherwise(F.coalesce(prefix, F.lit("")))
