"""JSON inside free text: span, tolerant parse, lists and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lograph.fixed_values import CONFIDENCE_LABELS, DEFAULT_CONFIDENCE

_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def json_span(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; null when there is no such span."""
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    found = (start > 0) & (F.instr(text, "}") > 0) & (end > start)
    return F.when(found, F.substring(text, start, end - start + 1))


def parse_object(text: Column) -> Column:
    """VARIANT of the span, null when it does not parse."""
    return F.try_parse_json(json_span(text))


def has(value: Column, path: str) -> Column:
    """Whether the key is there, even with the value null."""
    return F.coalesce(F.try_variant_get(value, path, "variant").isNotNull(), F.lit(False))


def text_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def first_text(value: Column, *paths: str) -> Column:
    """First non-empty text among the paths."""
    return F.coalesce(*[F.nullif(text_at(value, p), F.lit("")) for p in paths])


def items_at(value: Column, path: str) -> Column:
    """Elements of a JSON array; anything else gives an empty array."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))


def kind(value: Column) -> Column:
    """STRING, OBJECT, ARRAY, VOID or the scalar type name; null for a missing value."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def texts_at(value: Column, path: str) -> Column:
    """A list as texts. One string or object becomes a list of one, it is not split into characters."""
    node = F.try_variant_get(value, path, "variant")
    shape = kind(node)
    return (
        F.when(shape == "ARRAY", F.transform(items_at(value, path), lambda v: F.try_variant_get(v, "$", "string")))
        .when(node.isNull() | (shape == "VOID"), F.expr("cast(array() as array<string>)"))
        .otherwise(F.array(F.try_variant_get(node, "$", "string")))
    )


def confidence(value: Column, path: str = "$.confidence") -> Column:
    """A number as it is, a label by its first word, else the default. Blank counts as missing."""
    raw = text_at(value, path)
    shape = kind(F.try_variant_get(value, path, "variant"))
    word = F.get(F.split(F.trim(F.upper(raw)), r"\s+"), F.lit(0))
    label = None
    for name, number in CONFIDENCE_LABELS.items():
        label = F.when(word == name, F.lit(number)) if label is None else label.when(word == name, F.lit(number))
    return F.coalesce(
        F.when(shape == "BOOLEAN", F.when(raw == "true", F.lit(1.0)).otherwise(F.lit(0.0))),
        F.when(raw.rlike(_NUMBER), F.trim(raw).try_cast("double")),
        label,
        F.lit(DEFAULT_CONFIDENCE),
    )


def log_requests(value: Column) -> Column:
    """Requested file names: texts as they are, objects by the first known key, others dropped."""
    def name_of(item: Column) -> Column:
        shape = kind(item)
        first = None
        for key in ("file", "filename", "name", "path"):
            here = F.try_variant_get(item, f"$.{key}", "variant").isNotNull()
            text = F.coalesce(text_at(item, f"$.{key}"), F.lit("None"))
            first = F.when(here, text) if first is None else first.when(here, text)
        return F.when(shape == "STRING", text_at(item, "$")).when(shape == "OBJECT", first)

    return F.array_compact(F.transform(items_at(value, "$.request_logs"), name_of))
