"""Tables out of model replies: nodes, edges, merge over batches, actions, log requests.

``replies`` has ``response_id`` (the batch order) and ``response``. A reply that does not parse goes
to :func:`rejects`; it never removes what earlier replies gave.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograph.fixed_values import DEFAULT_RELATIONSHIP, UNKNOWN
from lograph.functions import replies as R
from lograph.functions.arn import last_part
from lograph.functions.text import strip_ansi, strip_text
from lograph.operators.graph import EDGE_KEY
from lograph.operators.running import latest


def parsed(replies: DataFrame) -> DataFrame:
    """Replies with the JSON object inside the text; ``data`` is null when there is none."""
    return replies.withColumn("data", R.parse_object(F.col("response")))


def rejects(replies: DataFrame) -> DataFrame:
    return parsed(replies).where("data is null").drop("data")


def _named_nodes(replies: DataFrame) -> DataFrame:
    """Node mentions with null where the reply leaves an attribute out."""
    items = parsed(replies).select("response_id", F.posexplode(R.items_at(F.col("data"), "$.nodes")).alias("pos", "item"))
    item = F.col("item")
    return items.select(
        "response_id", "pos", R.first_text(item, "$.resource_id", "$.arn").alias("arn"),
        R.text_at(item, "$.resource_type").alias("resource_type"), R.text_at(item, "$.name").alias("name"),
    ).where("arn is not null")


def reply_nodes(replies: DataFrame) -> DataFrame:
    """Nodes of each reply; of repeats inside a reply the last counts."""
    last = _named_nodes(replies).groupBy("response_id", "arn").agg(
        F.max_by(F.struct("resource_type", "name"), "pos").alias("node")
    )
    return last.select(
        "response_id", "arn", F.coalesce("node.resource_type", F.lit(UNKNOWN)).alias("resource_type"),
        F.coalesce("node.name", last_part(F.col("arn"))).alias("name"),
    )


def reply_edges(replies: DataFrame) -> DataFrame:
    """Edges of each reply in list order, repeats kept."""
    items = parsed(replies).select("response_id", F.posexplode(R.items_at(F.col("data"), "$.edges")).alias("pos", "item"))
    item = F.col("item")
    return items.select(
        "response_id", "pos",
        R.first_text(item, "$.source_id", "$.source_arn").alias("source_arn"),
        R.first_text(item, "$.target_id", "$.target_arn").alias("target_arn"),
        F.coalesce(R.text_at(item, "$.relationship"), F.lit(DEFAULT_RELATIONSHIP)).alias("relationship"),
    ).where("source_arn is not null and target_arn is not null")


def merged_nodes(replies: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Graph nodes over all replies: everything known stays, the latest given attribute wins.

    ``existing``: arn, resource_type, name; it counts as older than every reply.
    """
    named = _named_nodes(replies)
    if existing is not None:
        named = named.unionByName(existing.select(
            F.lit(None).cast("bigint").alias("response_id"), F.lit(-1).alias("pos"), "arn", "resource_type", "name"
        ))
    order = F.struct("response_id", "pos")
    return named.groupBy("arn").agg(
        latest(F.col("resource_type"), order).alias("resource_type"), latest(F.col("name"), order).alias("name")
    ).select(
        "arn", F.coalesce("resource_type", F.lit(UNKNOWN)).alias("resource_type"),
        F.coalesce("name", last_part(F.col("arn"))).alias("name"),
    )


def merged_edges(replies: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    edges = reply_edges(replies).select(*EDGE_KEY)
    if existing is not None:
        edges = edges.unionByName(existing.select(*EDGE_KEY))
    return edges.distinct()


def log_requests(replies: DataFrame) -> DataFrame:
    """Log files that a reply asks for, in order."""
    return parsed(replies).select(
        "response_id", F.posexplode(R.log_requests(F.col("data"))).alias("pos", "file_name")
    )


def reply_actions(replies: DataFrame, log_dir: str) -> DataFrame:
    """What each reply asks for: a tool run with its parameters, or a message.

    A tool run without ``log_dir`` gets the default. A reply without a JSON object is a message.
    """
    data, text = F.col("data"), strip_text(F.col("response"))
    action = F.when(data.isNull(), "respond").otherwise(F.coalesce(R.text_at(data, "$.action"), F.lit("respond")))
    is_tool = F.col("action") == "tool"
    return parsed(replies).withColumn("action", action).select(
        "response_id", "action",
        F.when(is_tool, F.coalesce(R.text_at(data, "$.tool"), F.lit(""))).alias("tool"),
        F.when(is_tool, F.coalesce(R.text_at(data, "$.params.log_dir"), F.lit(log_dir))).alias("log_dir"),
        F.when(is_tool, F.coalesce(F.to_json(F.try_variant_get(data, "$.params", "variant")), F.lit("{}"))).alias("params"),
        F.when(is_tool, F.lit(None)).when(F.col("action") == "respond", F.coalesce(R.text_at(data, "$.message"), text))
        .otherwise(text).alias("message"),
    )


def result_text(outputs: DataFrame) -> DataFrame:
    """Text of a command's JSON output: ``result``, else ``content`` as text or as text blocks.

    Output that does not parse is the text itself. ``outputs``: response_id, raw.
    """
    clean = outputs.withColumn("clean", strip_text(strip_ansi(F.col("raw"))))
    data = clean.withColumn("data", F.try_parse_json("clean"))
    content = F.try_variant_get("data", "$.content", "variant")
    texts = F.array_compact(F.transform(
        R.items_at(F.col("data"), "$.content"),
        lambda b: F.when(R.kind(b) == "STRING", R.text_at(b, "$")).when(
            R.text_at(b, "$.type") == "text", F.coalesce(R.text_at(b, "$.text"), F.lit(""))
        ),
    ))
    return data.select(
        "response_id",
        F.when(F.col("data").isNull(), F.col("clean")).otherwise(F.coalesce(
            F.nullif(R.text_at(F.col("data"), "$.result"), F.lit("")),
            F.when(R.kind(content) == "STRING", R.text_at(content, "$")),
            F.array_join(texts, "\n"),
        )).alias("text"),
        F.col("data").isNotNull().alias("parsed"),
    )
