"""Graph exports as text lines, and their writers.

Lines carry (part, node_id, edge_no, line_no); sorting by these gives the file. The sort is Spark's
range sort, so a large graph is written as many ordered files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograph.fixed_values import DEFAULT_COLOUR, SERVICE_COLOURS
from lograph.functions.arn import safe_name
from lograph.operators.graph import EDGE_KEY
from lograph.operators.running import numbered

ORDER = ["part", "node_id", "edge_no", "line_no"]

DOT_HEAD = ["digraph topology {", "    rankdir=LR;", "    node [shape=box, style=filled];", ""]
GRAPHML_HEAD = [
    '<?xml version="1.0" encoding="UTF-8"?>',
    '<graphml xmlns="http://graphml.graphstruct.org/graphml"',
    '         xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">',
    '  <key id="arn" for="node" attr.name="arn" attr.type="string"/>',
    '  <key id="resource_type" for="node" attr.name="resource_type" attr.type="string"/>',
    '  <key id="name" for="node" attr.name="name" attr.type="string"/>',
    '  <key id="relationship" for="edge" attr.name="relationship" attr.type="string"/>',
    '  <key id="request_count" for="edge" attr.name="request_count" attr.type="int"/>',
    '  <key id="error_count" for="edge" attr.name="error_count" attr.type="int"/>',
    '  <graph id="topology" edgedefault="directed">',
]


def _quoted(name: str) -> Column:
    return F.concat(F.lit('"'), safe_name(F.col(name)), F.lit('"'))


def _fixed(frame: DataFrame, part: int, lines: list[str]) -> DataFrame:
    rows = frame.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in lines])).alias("line_no", "line"))
    return rows.select(F.lit(part).alias("part"), F.lit("").alias("node_id"), F.lit(0).cast("bigint").alias("edge_no"), "line_no", "line")


def _each(rows: DataFrame, part: int, node_id: Column, edge_no: Column, lines: list[Column]) -> DataFrame:
    return rows.select(
        F.lit(part).alias("part"), node_id.alias("node_id"), edge_no.cast("bigint").alias("edge_no"),
        F.posexplode(F.array(*lines)).alias("line_no", "line"),
    )


def _numbered_edges(edges: DataFrame, order: str) -> DataFrame:
    return numbered(edges, [order, *EDGE_KEY], "edge_no")


def list_order(edges: DataFrame) -> str:
    """The list position: stored edges have one, fresh ones their first mention."""
    return "position" if "position" in edges.columns else "first_seq"


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Graphviz text."""
    order = list_order(edges)
    colour = F.try_element_at(
        F.create_map(*[F.lit(x) for pair in SERVICE_COLOURS.items() for x in pair]), F.substring_index("resource_type", ":", 1)
    )
    node_line = F.concat(
        F.lit("    "), _quoted("arn"), F.lit(' [label="'), "name", F.lit("\\n"), "resource_type", F.lit('", fillcolor='),
        F.coalesce(colour, F.lit(DEFAULT_COLOUR)), F.lit("];"),
    )
    edge_line = F.concat(
        F.lit("    "), _quoted("source_arn"), F.lit(" -> "), _quoted("target_arn"), F.lit(' [label="'), "relationship", F.lit('"];')
    )
    none = F.lit("")
    return (
        _fixed(nodes, 0, DOT_HEAD)
        .unionByName(_each(nodes, 1, F.col("arn"), F.lit(0), [node_line]))
        .unionByName(_fixed(nodes, 2, [""]))
        .unionByName(_each(_numbered_edges(edges, order), 3, none, F.col("edge_no"), [edge_line]))
        .unionByName(_fixed(nodes, 4, ["}"]))
    )


def escaped(text: Column) -> Column:
    """Text fit for XML."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def _data(key: str, value: Column) -> Column:
    return F.concat(F.lit(f'      <data key="{key}">'), escaped(value.cast("string")), F.lit("</data>"))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML text with escaped values; edges are numbered in list order."""
    order = list_order(edges)
    def attribute(name: str) -> Column:
        return escaped(safe_name(F.col(name)))

    node_lines = [
        F.concat(F.lit('    <node id="'), attribute("arn"), F.lit('">')),
        *[_data(c, F.col(c)) for c in ("arn", "resource_type", "name")],
        F.lit("    </node>"),
    ]
    edge_lines = [
        F.concat(F.lit('    <edge id="e'), F.col("edge_no").cast("string"), F.lit('" source="'), attribute("source_arn"),
                 F.lit('" target="'), attribute("target_arn"), F.lit('">')),
        *[_data(c, F.col(c)) for c in ("relationship", "request_count", "error_count")],
        F.lit("    </edge>"),
    ]
    return (
        _fixed(nodes, 0, GRAPHML_HEAD)
        .unionByName(_each(nodes, 1, F.col("arn"), F.lit(0), node_lines))
        .unionByName(_each(_numbered_edges(edges, order), 3, F.lit(""), F.col("edge_no"), edge_lines))
        .unionByName(_fixed(nodes, 4, ["  </graph>", "</graphml>"]))
    )


def write_lines(lines: DataFrame, path: str, order: list[str] = ORDER, single_file: bool = False) -> None:
    """Write ordered lines. ``single_file`` is for graphs small enough for one task to write."""
    ordered = lines.orderBy(*order).select("line")
    (ordered.coalesce(1) if single_file else ordered).write.mode("overwrite").text(path)
