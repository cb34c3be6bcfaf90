"""Validity columns. A bad row is reported, it does not fail the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograph.fixed_values import REGION_PATTERN


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


def valid_region(name: Column) -> Column:
    return F.coalesce(name.rlike(REGION_PATTERN), F.lit(False))


def valid_uuid(text: Column) -> Column:
    """32 hex digits once the optional ``urn:uuid:``, braces and hyphens are gone."""
    bare = F.regexp_replace(text, r"urn:|uuid:|-|^[{}]+|[{}]+$", "")
    return F.coalesce(F.regexp_replace(bare, r"^[{}]+|[{}]+$", "").rlike(r"^[0-9a-fA-F]{32}$"), F.lit(False))


def one_of(value: Column, allowed: list[str]) -> Column:
    return F.coalesce(value.isin(allowed), F.lit(False))


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with an ``errors`` array of the broken rules' names."""
    errors = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    checked = rows.withColumn("errors", errors)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)
