"""Text: terminal codes, sizes, chunks, reply text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lograph.fixed_values import ANSI_PATTERN, PRINTABLE_RUN, TEXT_CHUNK_CHARS


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI_PATTERN, "")


def strip_text(text: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` removes spaces only)."""
    return F.trim(text, F.lit(" \t\n\r\x0b\x0c"))


def credits_in(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"Credits:\s*([\d.]+)", 1).try_cast("double"), F.lit(0.0))


def seconds_in(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"Time:\s*(\d+)s", 1).try_cast("bigint"), F.lit(0))


def reply_text(raw: Column) -> Column:
    """Answer inside a terminal transcript.

    Everything from the first line that begins ``> `` up to the line with the usage mark, without
    the ``> ``; the whole text when no line begins so.
    """
    clean = strip_text(strip_ansi(raw))
    lines = F.split(clean, r"\r\n|\n|\r", -1)
    quoted = F.transform(lines, lambda line: line.startswith("> "))
    first = F.array_position(quoted, True)
    body = F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines))
    stops = F.transform(
        body,
        lambda line: ~line.startswith("> ") & (F.contains(line, F.lit("▸")) | F.contains(line, F.lit("Credits:"))),
    )
    stop = F.array_position(stops, True)
    kept = F.when(stop > 0, F.slice(body, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(body)
    answer = F.transform(
        kept, lambda line: F.when(line.startswith("> "), F.substring(line, 3, 2147483647)).otherwise(line)
    )
    return F.when(first > 0, strip_text(F.array_join(answer, "\n"))).otherwise(clean)


def human_size(size: Column) -> Column:
    """Size with one decimal, halves to even, in steps of 1024 from B to TB."""
    size = size.cast("double")

    def shown(power: int, unit: str) -> Column:
        return F.concat(F.format_string("%.1f", F.bround(size / F.lit(float(1024**power)), 1)), F.lit(unit))

    return (
        F.when(size < 1024.0, shown(0, "B"))
        .when(size < float(1024**2), shown(1, "KB"))
        .when(size < float(1024**3), shown(2, "MB"))
        .when(size < float(1024**4), shown(3, "GB"))
        .otherwise(shown(4, "TB"))
    )


def chunks(text: Column, size: int = TEXT_CHUNK_CHARS) -> Column:
    """Array of consecutive pieces of ``size`` characters; an empty text gives one empty piece."""
    last = F.greatest(F.ceil(F.length(text) / F.lit(size)) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def printable_runs(content: Column, shortest: int = PRINTABLE_RUN) -> Column:
    """Runs of printable ASCII, tab, line feed and carriage return in raw bytes."""
    pattern = r"[\x20-\x7E\t\n\r]{" + str(shortest) + ",}"
    return F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(pattern), F.lit(0))


def fingerprint(path: Column, size: Column, modified: Column, digits: int = 64) -> Column:
    """Hash of path, size and modification time in milliseconds; 16 digits give the short form."""
    return F.substring(F.sha2(F.concat_ws("|", path, size.cast("string"), modified.cast("string")), 256), 1, digits)


def change_id(*parts: Column) -> Column:
    """A UUID-shaped id that a retry repeats."""
    return F.regexp_replace(
        F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])),
        r"^(.{8})(.{4})(.{4})(.{4})(.{12})$",
        "$1-$2-$3-$4-$5",
    )
