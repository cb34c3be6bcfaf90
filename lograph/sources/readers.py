"""Readers: every log format as rows (path, line_no, line).

Plain logs of any size are split over tasks. Formats that need the whole file come as (path, content) from
:func:`lograph.sources.files.scan_content`.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ElementTree
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lograph.fixed_values import EVENT_BLOCK_PATTERN
from lograph.functions.tabular import cells, key_values, open_after
from lograph.functions.text import printable_runs, strip_text
from lograph.sources.files import any_case, path_groups, plain_path, scan_content, scan_files, suffix

LINE_BREAK = r"\r\n|\n|\r"
TEXT_SUFFIXES = [".log", ".txt", ".json", ".xml", ".rpt"]


def decoded(content: Column) -> Column:
    """UTF-8 text, bad bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))


def scan_lines(spark: SparkSession, root: str, suffixes: list[str] = TEXT_SUFFIXES) -> DataFrame:
    """Lines of plain logs, large files split over tasks; without line numbers."""
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", any_case(suffixes)).text(root)
    )
    return lines.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.make_valid_utf8("value").alias("line"))


def split_text_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of plain logs of any size, with their place: where their stretch of the file begins, and a number that grows inside it."""
    lines = spark.read.text(paths)
    return lines.select(
        plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"), F.make_valid_utf8("value").alias("line"))


def _split_lines(text: Column) -> Column:
    """Lines without a last empty one after the final line break."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def text_lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(_split_lines(decoded(F.col("content")))).alias("n", "line")).select(
        "path", (F.col("n") + 1).alias("line_no"), "line"
    )


def csv_lines(files: DataFrame, quoted_breaks: bool = False) -> DataFrame:
    """CSV as text: the header, a line of dashes, then ``name=value`` per row.

    ``quoted_breaks`` joins lines that an open quote runs over. It costs a shuffle by file.
    """
    if quoted_breaks:
        rows = _csv_records(files).withColumn("header", cells(F.col("header")))
    else:
        # The header is taken before the lines fan out, so that rows carry it and not the whole text.
        text = decoded(F.col("content"))
        whole = files.select(
            "path", cells(F.regexp_extract(text, r"^[^\r\n]*", 0)).alias("header"), _split_lines(text).alias("lines"))
        rows = whole.select("path", "header", F.posexplode("lines").alias("n", "record"))
    title = F.array_join("header", " | ")
    return rows.withColumn("row", cells(F.col("record"))).select("path", "n", F.explode(
        F.when(F.col("n") == 0, F.array(
            F.struct(F.lit(1).alias("line_no"), title.alias("line")),
            F.struct(F.lit(2).alias("line_no"), F.repeat(F.lit("-"), F.length(title)).alias("line")),
        )).otherwise(F.array(F.struct(
            (F.col("n") + 2).cast("int").alias("line_no"),
            key_values(F.col("header"), F.col("row")).alias("line"))))
    ).alias("out")).select("path", "out.line_no", "out.line")


def _csv_records(files: DataFrame) -> DataFrame:
    """Lines put together to records where a quote is open.

    A line keeps the state, turns it, or sets it whatever it was: the state after a line is that of the last line that set it,
    turned by the lines since.
    """
    lines = files.select("path", F.posexplode(_split_lines(decoded(F.col("content")))).alias("i", "line"))
    before = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    from_closed, from_open = open_after(F.col("line"))
    moved = lines.withColumns({"from_closed": from_closed.cast("int"), "from_open": from_open.cast("int")})
    turned = moved.withColumn("turns", F.sum(F.when(F.col("from_closed") > F.col("from_open"), 1).otherwise(0)).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(F.col("from_closed") == F.col("from_open"), F.struct(F.col("from_closed").alias("state"), "turns")), ignorenulls=True).over(before)
    so_far = F.lag("turns", 1, 0).over(Window.partitionBy("path").orderBy("i"))
    state = F.coalesce(last["state"], F.lit(0)) + so_far - F.coalesce(last["turns"], F.lit(0))
    closed = turned.withColumn("open", state % 2).drop("from_closed", "from_open", "turns")
    upto = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    keyed = closed.withColumn("n", F.sum(1 - F.col("open")).over(upto) - 1)
    records = keyed.groupBy("path", "n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda r: r["line"]), "\n").alias("record")
    )
    first = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("header", F.first("record").over(first))


_TAG = r"""(?s)<!--.*?-->[^<]*|<(?:"[^"]*+"|'[^']*+'|[^>"'])*+>[^<]*"""
_ATTRIBUTE = r"""([\w:.\-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def _unescape(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        if char == "&":  # last, so that no new entity comes up
            text = _numbered_characters(text)
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _numbered_characters(text: Column) -> Column:
    """``&#65;`` and ``&#x41;`` as the characters they name."""
    def character(entity: Column) -> Column:
        code = F.when(entity.rlike("^&#[xX]"), F.conv(F.regexp_extract(entity, "([0-9a-fA-F]+);", 1), 16, 10)).otherwise(
            F.regexp_extract(entity, "([0-9]+);", 1)).try_cast("bigint")
        known = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(entity)

    found = F.array_distinct(F.regexp_extract_all(text, F.lit("&#(?:[0-9]{1,9}|[xX][0-9a-fA-F]{1,8});"), F.lit(0)))
    return F.when(F.contains(text, F.lit("&#")), F.aggregate(found, text, lambda t, e: F.replace(t, e, character(e)))).otherwise(text)


def _without_sections(xml: Column) -> Column:
    """Character sections as escaped text."""
    parts = F.split(xml, r"<!\[CDATA\[|\]\]>")
    plain = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, p).otherwise(
        F.replace(F.replace(F.replace(p, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))), "")
    return F.when(F.contains(xml, F.lit("<![CDATA[")), plain).otherwise(xml)


def _sound(xml: Column) -> Column:
    """Whether Spark's XML parser takes the text as one document."""
    parsed = F.from_xml(xml, "_corrupt_record string", {"mode": "PERMISSIVE"})
    return parsed["_corrupt_record"].isNull()


def _attributes(tag: Column) -> Column:
    names = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1))
    double = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(2))
    single = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(3))
    values = F.zip_with(double, single, lambda d, s: _unescape(F.concat(d, s)))
    return F.concat(
        F.lit("{"),
        F.array_join(F.zip_with(names, values, lambda n, v: F.concat(F.lit("'"), n, F.lit("': '"), v, F.lit("'"))), ", "),
        F.lit("}"),
    )


def xml_elements(blobs: DataFrame) -> DataFrame:
    """Elements of the event blocks inside each blob: path, event_no, n, depth, tag, attributes, value.

    Blobs without an event block count as one document with event_no 0. ``sound`` is false where the text is no
    well-formed XML; ``start`` of its first row then holds the block. ``blobs``: path, text.
    """
    blocks = F.regexp_extract_all("text", F.lit(EVENT_BLOCK_PATTERN), F.lit(0))
    numbered = F.when(F.size(blocks) > 0, F.transform(blocks, lambda b, i: F.struct((i + 1).alias("no"), b.alias("xml")))).otherwise(
        F.array(F.struct(F.lit(0).alias("no"), F.col("text").alias("xml")))
    )
    events = blobs.select("path", F.explode(numbered).alias("e")).select(
        "path", F.col("e.no").alias("event_no"), F.col("e.xml").alias("start"),
        F.regexp_extract_all(_without_sections(F.col("e.xml")), F.lit(_TAG), F.lit(0)).alias("tokens"), _sound(F.col("e.xml")).alias("whole"),
    )
    tokens = events.select("path", "event_no", "start", "whole", F.posexplode_outer("tokens").alias("n", "token"))
    tag = F.regexp_extract("token", r"""(?s)^<((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>""", 1)
    rows = tokens.select(
        "path", "event_no", "n", "whole", F.when(F.coalesce("n", F.lit(0)) == 0, F.col("start")).alias("start"), tag.alias("inner"),
        F.regexp_extract("token", r"(?s)>([^<]*)$", 1).alias("after"),
    )
    inner = F.col("inner")
    opens = ~inner.rlike(r"^[/!?]") & (inner != "")
    ends_itself = inner.endswith("/")
    step = F.when(inner.startswith("/"), -1).when(opens & ~ends_itself, 1).otherwise(0)
    here = Window.partitionBy("path", "event_no")
    before = here.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum("step").over(before), F.lit(0))
    measured = rows.withColumns({"step": step, "opens": opens}).withColumns({
        "depth": depth, "total": F.sum("step").over(here), "elements": F.count_if("opens").over(here)
    })
    value = strip_text(_unescape(F.col("after")))
    return measured.where("opens or coalesce(n, 0) = 0").select(
        "path", "event_no", "n", "depth", "opens", (F.col("whole") & (F.col("total") == 0) & (F.col("elements") > 0)).alias("sound"), "start",
        F.regexp_extract("inner", r"^([^\s/]+)", 1).alias("tag"), _attributes(inner).alias("attributes"),
        F.when(~ends_itself, value).otherwise("").alias("value"),
    )


def xml_event_lines(blobs: DataFrame) -> DataFrame:
    """Event blocks as text lines: path, event_no, line_no, line.

    An element shows its value and its attributes, a child of it its value. A block whose tags do not
    balance shows its whole text, line by line. A document without events shows its whole tree; one that is
    no XML gives no lines.
    """
    rows = xml_elements(blobs)
    has_value, has_attributes = F.col("value") != "", F.col("attributes") != "{}"
    title = F.concat(F.lit("[Event "), F.col("event_no").cast("string"), F.lit("] "))
    whole = F.concat(
        F.repeat(F.lit("  "), F.col("depth").cast("int")), "tag",
        F.when(has_attributes, F.concat(F.lit(" "), "attributes")).otherwise(""),
        F.when(has_value, F.concat(F.lit(": "), "value")).otherwise(""),
    )
    line = (
        F.when(~F.col("sound"), F.when((F.coalesce("n", F.lit(0)) == 0) & (F.col("event_no") > 0),
                                      F.transform(_split_lines(F.col("start")), lambda text, i: F.concat(F.when(i == 0, title).otherwise(""), text))))
        .when(~F.col("opens"), F.lit(None))
        .when(F.col("event_no") == 0, F.array(whole))
        .when(F.col("depth") == 0, F.array(F.concat(title, F.col("tag"), F.lit(" "), F.col("attributes"))))
        .when(F.col("depth") == 1, F.array(
            F.when(has_value, F.concat(F.lit("  "), "tag", F.lit(": "), "value")),
            F.when(has_attributes, F.concat(F.lit("  "), "tag", F.lit(" attrs: "), "attributes"))))
        .when((F.col("depth") == 2) & has_value, F.array(F.concat(F.lit("    "), "tag", F.lit(": "), "value")))
    )
    return rows.select("path", "event_no", "n", F.posexplode(line).alias("k", "line")).where("line is not null").select(
        "path", "event_no", (F.coalesce("n", F.lit(0)).cast("bigint") * 2 + F.col("k")).alias("line_no"), "line"
    )


def printable_lines(blobs: DataFrame) -> DataFrame:
    """Readable runs of binary content. ``blobs``: path, content."""
    return blobs.select("path", F.posexplode(printable_runs(F.col("content"))).alias("n", "line")).select(
        "path", (F.col("n") + 1).alias("line_no"), "line"
    )


def event_file_lines(files: DataFrame) -> DataFrame:
    """Binary event files: their XML events, or the readable runs where there is no XML."""
    events = xml_event_lines(files.select("path", decoded(F.col("content")).alias("text")))
    numbered = events.withColumn(
        "line_no", F.row_number().over(Window.partitionBy("path").orderBy("event_no", "line_no"))
    ).select("path", "line_no", "line")
    bare = files.join(events.select("path").distinct(), "path", "left_anti")
    return numbered.unionByName(printable_lines(bare))


def document_lines(files: DataFrame) -> DataFrame:
    """Texts of word-processor archives, element by element; a damaged archive gives no lines."""
    def texts(content: bytes) -> list[str]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                root = ElementTree.fromstring(archive.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return []
        found = (part for element in root.iter() for part in (element.text, element.tail))
        return [part.strip() for part in found if part and part.strip()]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = pd.DataFrame({"path": batch["path"], "line": batch["content"].map(texts)})
            batch["line_no"] = batch["line"].map(lambda lines: list(range(1, len(lines) + 1)))
            rows = batch.explode(["line", "line_no"]).dropna(subset=["line"])
            yield rows[["path", "line_no", "line"]].astype({"line_no": "int32"})

    return files.select("path", "content").mapInPandas(read, "path string, line_no int, line string")


#: What one row can hold.
WHOLE_BYTES = (1 << 31) - (1 << 16)
WHOLE_SUFFIXES = [".csv", ".xel", ".docx"]
LINES = "path string, block bigint, line_no bigint, line string"


def unread_reason(files: DataFrame) -> DataFrame:
    """Files that no reader takes, with the reason: path, reason. ``files``: path, length."""
    kind = suffix(F.col("path"))
    reason = F.when(~kind.isin(TEXT_SUFFIXES + WHOLE_SUFFIXES), "format not read").when(
        kind.isin(WHOLE_SUFFIXES) & (F.col("length") > WHOLE_BYTES), "too large for a format that is read whole")
    return files.select("path", reason.alias("reason")).where("reason is not null")


def lines_of(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Lines of the named files (path, length) of every format, with their place (path, block, line_no).

    The files are chosen on their metadata, then only they are read: plain text split over tasks, other
    formats file by file.
    """
    kind = suffix(F.col("path"))
    readers = {".csv": lambda f: csv_lines(f, quoted_breaks=True), ".xel": event_file_lines, ".docx": document_lines}
    out = spark.createDataFrame([], LINES)
    for paths in path_groups(files.where(kind.isin(TEXT_SUFFIXES) & (F.col("length") > 0))):
        out = out.unionByName(split_text_lines(spark, paths))
    for name, read in readers.items():
        for paths in path_groups(files.where((kind == name) & F.col("length").between(1, WHOLE_BYTES))):
            found = read(scan_content(spark, paths, [name]))
            out = out.unionByName(found.select("path", F.lit(0).cast("bigint").alias("block"), F.col("line_no").cast("bigint"), "line"))
    return out


def file_lines(spark: SparkSession, root: str, after: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """Lines of every supported format under a folder.

    ``only`` (path) keeps the named files, ``after`` those modified since.
    """
    files = scan_files(spark, root, after=after)
    return lines_of(spark, files if only is None else files.join(only.select("path"), "path", "left_semi"))


def unreadable(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Files without any line: damaged, or of a format that needs an outside service."""
    return files.select("path").join(lines.select("path").distinct(), "path", "left_anti")


def typed_events(spark: SparkSession, root: str, schema: str, row_tag: str = "event") -> DataFrame:
    """Well-formed XML logs with known fields, split over tasks by the row tag."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(root)
