"""CSV lines as ``name=value`` text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Possessive runs: a cell of any length is read without recursion.
_CELL = r',("(?:[^"]++|"")*+"[^,]*+|[^,]*+)'


def cells(line: Column) -> Column:
    """Cells of one CSV line; quoted cells lose their quotes. A blank line has none."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1))
    plain = F.transform(
        found,
        lambda c: F.when(c.startswith('"'), F.regexp_replace(F.regexp_replace(c, r'^"|"([^"]*)$', "$1"), '""', '"'))
        .otherwise(c),
    )
    return F.when(line == "", F.expr("cast(array() as array<string>)")).otherwise(plain)


_WHOLE = r'(?:"(?:[^"]++|"")*+"[^,]*+|(?!")[^,]*+)'


def open_after(line: Column) -> tuple[Column, Column]:
    """Whether a quote is open after the line, if none was open before it, and if one was.

    A quote opens only at the start of a cell; inside an unquoted cell it is a character like others.
    """
    return ~line.rlike(f"^{_WHOLE}(?:,{_WHOLE})*+$"), ~line.rlike(f'^(?:[^"]++|"")*+"[^,]*+(?:,{_WHOLE})*+$')


def key_values(header: Column, row: Column) -> Column:
    """``h1=v1 | h2=v2``: a short row stops early, cells beyond the header stand bare."""
    pairs = F.zip_with(header, row, lambda h, v: F.coalesce(F.concat(h, F.lit("="), v), v))
    return F.array_join(F.slice(pairs, F.lit(1), F.size(row)), " | ")
