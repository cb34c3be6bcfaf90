"""Queries on what is listed and written: files by name and time, documents, resource map, reports, artifacts."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograph.functions import checks
from lograph.operators import graph as G
from lograph.operators import health as H
from lograph.operators import reports as S
from lograph.operators import usage as U
from lograph.operators.replies import merged_nodes
from lograph.plans.graph_queries import MENTIONS_CTE, NODES_CTE, SIGNALS_CTE, findings, fresh_nodes
from lograph.plans.reply_queries import REPORT, on_replies, replies
from lograph.plans.views import oracle, table
from lograph.plans.work_queries import COST, SESSION_COLUMNS, calls
from lograph.session import scratch_path
from lograph.sinks import tables as T
from lograph.sources import files as L
from lograph.sources import readers as R
from lograph.sources import snapshots as V

AT = "timestamp_ntz '2024-02-01 10:20:30'"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a listing of files; a name stands in many folders."""
    name = F.concat(F.lit("/logs/"), "source", F.lit("/doc-"), (F.col("doc_id") % 97).cast("string"), F.lit(".log"))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/day-"), F.floor(F.col("doc_id") / 97).cast("string"), name).alias("path"), F.col("n_chars").alias("length"),
        (F.expr("timestamp '2024-01-01 00:00:00'") + F.make_interval(hours=(F.col("doc_id") % 500).cast("int"))).alias("modificationTime"))


def first_per_name(spark, sf_dir):
    return L.first_per_name(listing(spark, sf_dir)).select("path", "length")


def modified_since(spark, sf_dir):
    """Files of a listing that changed since some hour, that hour included."""
    return L.modified_since(listing(spark, sf_dir), F.expr("timestamp '2024-01-11 04:00:00'")).select("path", "length")


def docx_lines(spark, sf_dir):
    """Documents packed as word-processor archives and read back, one in eleven of them damaged."""
    def pack(batches):
        for batch in batches:
            content = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as archive:
                    archive.writestr("word/document.xml", f"<w><p>{escape(text or '')}</p></w>")
                content.append(out.getvalue()[:40] if doc_id % 11 == 0 else out.getvalue())
            yield pd.DataFrame({"path": batch["doc_id"].astype(str), "content": content})

    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^\\x20-\\x7E]", "?").alias("text"))
    lines = R.document_lines(docs.mapInPandas(pack, "path string, content binary"))
    return lines.select(F.col("path").cast("bigint").alias("doc_id"), F.col("line_no").cast("bigint").alias("line_no"), F.md5("line").alias("digest"))


def resource_map(spark, sf_dir):
    """The resource map written and read back: nodes with what leaves them."""
    path, found = scratch_path(spark, "resource_map"), findings(spark, sf_dir)
    nodes = G.resource_nodes(found).withColumn("properties", F.create_map(F.lit("origin"), F.col("region")))
    V.write_resource_tables(nodes, G.resource_edges(found), path)
    stored, edges = V.read_resource_tables(spark, path)
    out = edges.groupBy(F.col("source_arn").alias("arn")).agg(F.count(F.lit(1)).alias("links"))
    return stored.join(out, "arn", "left").select(
        "arn", "resource_type", "name", "region", F.col("properties")["origin"].alias("origin"), F.coalesce("links", F.lit(0)).alias("links"))


def _reports(spark, sf_dir):
    return S.report_fields(replies(spark, sf_dir), F.col("response_id") % 7)


def report_files(spark, sf_dir):
    """Reports written as JSON lines and read back."""
    path = scratch_path(spark, "reports")
    T.write_reports(_reports(spark, sf_dir), path)
    fields = "response_id bigint, parsed boolean, confidence double, root_cause_chain array<string>, source_evidence array<string>, iterations_used bigint"
    return spark.read.schema(fields).json(path).select(
        "response_id", "parsed", "confidence", F.array_join("root_cause_chain", ",").alias("root_cause_chain"),
        F.size("source_evidence").cast("bigint").alias("evidence"), "iterations_used")


def report_heads(spark, sf_dir):
    """Head and usage section of all reports, with the time, the depth and what the run took."""
    found = replies(spark, sf_dir)
    total = U.run_usage(U.session_usage(calls(spark, sf_dir))).where("level = 3")
    lines = S.report_lines(_reports(spark, sf_dir), merged_nodes(found), generated_at=F.expr(AT), usage=total)
    return lines.where("section_no in (1, 7)").select(
        "response_id", F.col("section_no").cast("bigint").alias("section_no"), F.col("line_no").cast("bigint").alias("line_no"), "line")


def report_support(spark, sf_dir):
    """Findings on the resources of reports that name the most used tables."""
    chains = findings(spark, sf_dir).select(
        (F.col("seq") % 50).alias("response_id"), F.slice("resource_arns", 1, 1).alias("root_cause_chain")).where("seq < 200")
    chains = chains.groupBy("response_id").agg(F.flatten(F.collect_list("root_cause_chain")).alias("root_cause_chain"))
    return S.supporting_findings(chains, findings(spark, sf_dir)).select("response_id", "seq", "severity", "message")


def artifacts(spark, sf_dir):
    """All artifacts of a topology written to one folder: how many lines each has."""
    path, found, nodes = scratch_path(spark, "artifacts"), findings(spark, sf_dir), fresh_nodes(spark, sf_dir)
    T.write_artifacts(G.resource_nodes(found), G.edge_weights(found), H.health_audit(found, nodes, "batch-1"), path)
    counts = [spark.read.text(f"{path}/{name}").agg(F.lit(name).alias("artifact"), F.count(F.lit(1)).alias("lines"))
              for name in ("nodes", "edges", "dot", "graphml", "audit")]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def valid_uuids(spark, sf_dir):
    """Ids in many spellings: bare, hyphened, with braces or a prefix, too short, with other letters."""
    h = F.md5(F.col("c_custkey").cast("string"))
    hyphened = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    forms = F.array(h, hyphened, F.concat(F.lit("{"), hyphened, F.lit("}")), F.concat(F.lit("urn:uuid:"), hyphened), F.upper(hyphened),
                    F.substring(hyphened, 1, 35), F.replace(hyphened, F.lit("-"), F.lit("_")), F.concat(F.lit("g"), F.substring(h, 2, 31)), F.lit(""), F.lit(None))
    ids = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(forms).alias("form", "id"))
    return ids.select("c_custkey", F.col("form").cast("bigint").alias("form"), checks.valid_uuid(F.col("id")).alias("valid"), checks.not_blank(F.col("id")).alias("there"))


QUERIES = {f.__name__: f for f in [
    first_per_name, modified_since, docx_lines, resource_map, report_files, report_heads, report_support, artifacts, valid_uuids,
]}

LISTING = """l AS (SELECT '/day-' || (doc_id // 97) || '/logs/' || source || '/doc-' || (doc_id % 97) || '.log' AS path, n_chars AS length,
    'doc-' || (doc_id % 97) || '.log' AS name, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (doc_id % 500) AS changed FROM documents)"""
CALLS = COST.replace("{src}", "usage_v")
ORACLES = {
    "first_per_name": f"WITH {LISTING} SELECT min(path) AS path, arg_min(length, path) AS length FROM l GROUP BY name",
    "modified_since": f"WITH {LISTING} SELECT path, length FROM l WHERE changed >= TIMESTAMP '2024-01-11 04:00:00'",
    "docx_lines": r"""SELECT doc_id, CAST(1 AS BIGINT) AS line_no, md5(t) AS digest
        FROM (SELECT doc_id, trim(regexp_replace(text, '[^\x20-\x7E]', '?', 'g')) AS t FROM documents) WHERE doc_id % 11 <> 0 AND t <> ''""",
    "resource_map": oracle("WITH " + NODES_CTE + "," + MENTIONS_CTE + """ SELECT arn, resource_type, name, region, region AS origin,
        (SELECT count(*) FROM edges WHERE source_arn = arn) AS links FROM nodes""", "findings_v"),
    "report_files": on_replies(REPORT, """SELECT response_id, parsed, confidence, array_to_string(chain, ',') AS root_cause_chain,
        CAST(evidence AS BIGINT) AS evidence, response_id % 7 AS iterations_used FROM rep"""),
    "report_heads": oracle("WITH " + REPORT + "," + CALLS + """,
        u AS (SELECT count(*) AS n, CAST(round(sum(cost), 2) AS DOUBLE) AS c, CAST(sum(total_time_secs) AS BIGINT) AS s FROM sessions WHERE turns > 0)
        SELECT response_id, CAST(1 AS BIGINT) AS section_no, CAST(i - 1 AS BIGINT) AS line_no, l[i] AS line FROM (SELECT response_id,
            ['# Incident Report', '', 'Generated: 2024-02-01 10:20:30 UTC', 'Confidence: ' || confidence, 'Investigation depth: ' || (response_id % 7) || ' iterations', ''] AS l,
            unnest(generate_series(1, 6)) AS i FROM rep)
        UNION ALL SELECT response_id, 7, i - 1, l[i] FROM (SELECT response_id, ['## Credit Usage', '', '| Metric | Value |', '|--------|-------|',
            '| Sessions | ' || n || ' |', '| Credits | ' || c || ' |', '| Time | ' || s || 's |', ''] AS l, unnest(generate_series(1, 8)) AS i FROM rep, u)""",
        "responses_v", "usage_v"),
    "report_support": oracle("""WITH m AS (SELECT seq, severity, message, CASE WHEN starts_with(a, 'arn:aws:s3:::') THEN regexp_replace(a, '^(arn:aws:s3:::[^/]*)/.*$', '\\1') ELSE rtrim(a, '/') END AS arn
          FROM (SELECT seq, severity, message, arn1 AS a FROM findings_v UNION SELECT seq, severity, message, arn2 FROM findings_v WHERE arn2 IS NOT NULL)),
        c AS (SELECT DISTINCT seq % 50 AS response_id, arn1 AS arn FROM findings_v WHERE seq < 200)
        SELECT DISTINCT response_id, seq, severity, message FROM m JOIN c USING (arn)""", "findings_v"),
    "artifacts": oracle("WITH " + NODES_CTE + "," + MENTIONS_CTE + "," + SIGNALS_CTE + """,
        steps AS (SELECT r, coalesce(max(r) OVER (PARTITION BY arn ORDER BY seq, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rb FROM signals),
        n AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges,
          (SELECT count(*) FROM steps WHERE r = 2 OR (r = 1 AND rb = 0)) AS audit)
        SELECT 'nodes' AS artifact, nodes AS lines FROM n UNION ALL SELECT 'edges', edges FROM n UNION ALL SELECT 'audit', audit FROM n
        UNION ALL SELECT 'dot', 6 + nodes + edges FROM n UNION ALL SELECT 'graphml', 12 + 5 * nodes + 5 * edges FROM n""", "findings_v"),
    "valid_uuids": """SELECT c_custkey, CAST(form AS BIGINT) AS form, form < 5 AS valid, form < 8 AS there FROM customer, (SELECT unnest(generate_series(0, 9)) AS form)""",
}
