"""Column functions on whole texts, inside Spark's own expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words, as a pattern: space and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Array elements per step of :func:`sums_before`; a step copies what came before it.
STEP = 256
SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` needs it inside another lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sums_before(values: Column) -> Column:
    """For each element of an array of bigint the sum of all before it.

    Summed in steps of ``STEP`` elements, so that the cost stays near linear for long arrays. ``values``
    should be a bound value (see :func:`let`).
    """
    def step(done: Column, k: Column) -> Column:
        inside = F.aggregate(
            F.slice(values, k * STEP + 1, STEP),
            F.struct(done["total"].alias("total"), F.array().cast("array<bigint>").alias("sums")),
            lambda a, v: F.struct((a["total"] + v).alias("total"), F.concat(a["sums"], F.array(a["total"])).alias("sums")),
        )
        return let(inside, lambda i: F.struct(i["total"].alias("total"), F.concat(done["sums"], i["sums"]).alias("sums")))

    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int")))
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("sums"))
    return F.aggregate(steps, start, step, lambda a: a["sums"])


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern, left to right, as structs ``start``, ``end`` (code points, end exclusive), ``value``.

    The pattern must not match the empty string. The pieces between matches give the positions:
    splitting and extracting walk the text in the same way.
    """
    def spans(found: Column) -> Column:
        pieces = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.length)
        widths = F.zip_with(pieces, found, lambda p, m: (p + F.length(m)).cast("bigint"))
        ends = let(widths, lambda w: F.zip_with(sums_before(w), w, lambda before, width: before + width))
        return F.zip_with(
            found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")),
        )

    none = F.array().cast(SPANS)
    return F.coalesce(
        let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(none)), none,
    )
