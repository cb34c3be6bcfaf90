"""Queries on model replies and root-cause reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograph.functions import text as T
from lograph.operators import health as H
from lograph.operators import graph as G
from lograph.operators import replies as P
from lograph.operators import reports as S
from lograph.plans.graph_queries import MENTIONS_CTE, NODES_CTE, SIGNALS_CTE, findings, fresh_nodes
from lograph.plans.views import oracle, table, view

# Replies that ask for an action, answer as text, or wrap the answer in command output.
ACTIONS_SQL = """
SELECT conv_id * 1000 + turn AS response_id, CASE (conv_id + turn) % 5
  WHEN 0 THEN 'Sure. {"action":"tool","tool":"topology_update","params":{"depth":' || CAST(turn AS STRING) || '}}'
  WHEN 1 THEN '{"action":"tool","tool":"error_root_cause","params":{"log_dir":"/data/' || CAST(conv_id AS STRING) || '"}}'
  WHEN 2 THEN ' {"action":"respond","message":"' || role || ' done"} '
  WHEN 3 THEN '{"message":"hello ' || role || '"}'
  ELSE '  ' || role || ' says {not json}  ' END AS response
FROM conversations"""
OUTPUTS_SQL = """
SELECT conv_id * 1000 + turn AS response_id, CASE (conv_id + turn) % 5
  WHEN 0 THEN '{"result":"answer ' || role || '","usage":{"input_tokens":5}}'
  WHEN 1 THEN '{"result":"","content":"plain ' || role || '"}'
  WHEN 2 THEN '{"content":[{"type":"text","text":"a ' || role || '"},"b",{"type":"tool_use","text":"no"},{"type":"text"}]}'
  WHEN 3 THEN chr(27) || '[32m{"result":"coloured"}' || chr(27) || '[0m'
  ELSE '  not json ' || role END AS raw
FROM conversations"""
TERMINAL_SQL = """
SELECT conv_id * 1000 + turn AS response_id, CASE (conv_id + turn) % 3
  WHEN 0 THEN 'banner' || chr(10) || chr(27) || '[1m> ' || role || chr(27) || '[0m' || chr(10) || 'turn ' || CAST(turn AS STRING) || chr(10) || 'Credits: 1' || chr(10) || 'tail'
  WHEN 1 THEN '  ' || role || ' without mark  '
  ELSE '> one' || chr(10) || '> ' || role || chr(10) || '▸ Time' END AS raw
FROM conversations"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "responses_v")


def _shaped(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return spark.sql(sql)


def _big(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast("bigint") for c in columns})


def reply_nodes(spark, sf_dir):
    return P.reply_nodes(replies(spark, sf_dir))


def reply_edges(spark, sf_dir):
    return _big(P.reply_edges(replies(spark, sf_dir)), "pos")


def reply_rejects(spark, sf_dir):
    return P.rejects(replies(spark, sf_dir))


def reply_merge_nodes(spark, sf_dir):
    stored = view(spark, sf_dir, "edit_nodes_v").select("arn", "resource_type", "name")
    return P.merged_nodes(replies(spark, sf_dir), stored)


def reply_merge_edges(spark, sf_dir):
    return P.merged_edges(replies(spark, sf_dir), view(spark, sf_dir, "edit_edges_v"))


def log_requests(spark, sf_dir):
    return _big(P.log_requests(replies(spark, sf_dir)), "pos")


def report_fields(spark, sf_dir):
    reports = S.report_fields(replies(spark, sf_dir))
    return reports.select(
        "response_id", "parsed", "confidence", "hypothesis", F.array_join("root_cause_chain", ",").alias("root_cause_chain"),
        F.array_join("narrative", ",").alias("narrative"), "suggested_remediation",
        F.size("source_evidence").cast("bigint").alias("evidence"),
    )


def chain_roles(spark, sf_dir):
    return _big(S.chain_roles(S.report_fields(replies(spark, sf_dir))), "pos")


def chain_labels(spark, sf_dir):
    found = replies(spark, sf_dir)
    return _big(S.with_labels(S.chain_roles(S.report_fields(found)), P.merged_nodes(found)), "pos")


def evidence_rows(spark, sf_dir):
    rows = _big(S.evidence_rows(S.report_fields(replies(spark, sf_dir))), "pos")
    return rows.select("response_id", "pos", "plain", "source_file", "excerpt", "relevance")


def result_summary(spark, sf_dir):
    return S.result_summary(S.report_fields(replies(spark, sf_dir)))


def report_lines(spark, sf_dir):
    found = replies(spark, sf_dir)
    return _big(S.report_lines(S.report_fields(found), P.merged_nodes(found)), "section_no", "item_no", "line_no")


def topology_lines(spark, sf_dir):
    found, nodes = findings(spark, sf_dir), fresh_nodes(spark, sf_dir)
    edges = G.labelled_edges(G.resource_edges(found), nodes, short_fallback=True)
    return _big(S.topology_lines(H.health_state(found, nodes), edges), "part")


def reply_actions(spark, sf_dir):
    return P.reply_actions(_shaped(spark, sf_dir, ACTIONS_SQL), "/logs")


def result_text(spark, sf_dir):
    return P.result_text(_shaped(spark, sf_dir, OUTPUTS_SQL))


def reply_text(spark, sf_dir):
    return _shaped(spark, sf_dir, TERMINAL_SQL).select("response_id", T.reply_text(F.col("raw")).alias("text"))


QUERIES = {f.__name__: f for f in [
    reply_nodes, reply_edges, reply_rejects, reply_merge_nodes, reply_merge_edges, log_requests, report_fields, chain_roles,
    chain_labels, evidence_rows, result_summary, report_lines, topology_lines, reply_actions, result_text, reply_text,
]}

PARSED_CTE = r"""
span AS (SELECT *, nullif(regexp_extract(response, '(?s)\{.*\}'), '') AS s FROM responses_v),
parsed AS (SELECT response_id, response, CASE WHEN s IS NOT NULL AND json_valid(s) THEN CAST(s AS JSON) END AS j FROM span)"""
NODES = PARSED_CTE + """,
named AS (SELECT response_id, pos, coalesce(nullif(json_extract_string(item, '$.resource_id'), ''), nullif(json_extract_string(item, '$.arn'), '')) AS arn,
    json_extract_string(item, '$.resource_type') AS t, json_extract_string(item, '$.name') AS n
  FROM (SELECT response_id, unnest(json_extract(j, '$.nodes[*]')) AS item,
      generate_subscripts(json_extract(j, '$.nodes[*]'), 1) - 1 AS pos FROM parsed WHERE j IS NOT NULL)),
rnodes AS (SELECT * FROM named WHERE arn IS NOT NULL),
graph_nodes AS (SELECT arn, coalesce(arg_max(t, response_id * 1000 + pos), 'unknown') AS resource_type,
  coalesce(arg_max(n, response_id * 1000 + pos), string_split(arn, ':')[-1]) AS name FROM rnodes GROUP BY arn),
redges AS (SELECT response_id, pos, coalesce(nullif(json_extract_string(item, '$.source_id'), ''), nullif(json_extract_string(item, '$.source_arn'), '')) AS source_arn,
    coalesce(nullif(json_extract_string(item, '$.target_id'), ''), nullif(json_extract_string(item, '$.target_arn'), '')) AS target_arn,
    coalesce(json_extract_string(item, '$.relationship'), 'connected_to') AS relationship
  FROM (SELECT response_id, unnest(json_extract(j, '$.edges[*]')) AS item,
      generate_subscripts(json_extract(j, '$.edges[*]'), 1) - 1 AS pos FROM parsed WHERE j IS NOT NULL))"""
REPORT = NODES + r""",
rep AS (SELECT response_id, response, j, j IS NOT NULL AS parsed,
  CASE WHEN j IS NULL THEN 0.3e0 ELSE coalesce(TRY_CAST(conf AS DOUBLE), CASE string_split(upper(trim(conf)), ' ')[1]
    WHEN 'HIGH' THEN 0.85e0 WHEN 'MEDIUM' THEN 0.6e0 WHEN 'LOW' THEN 0.3e0 WHEN 'VERY' THEN 0.9e0 END, 0.5e0) END AS confidence,
  CASE WHEN j IS NULL THEN response ELSE coalesce(json_extract_string(j, '$.hypothesis'), '') END AS hypothesis,
  coalesce(json_extract_string(j, '$.root_cause_chain[*]'), []) AS chain, coalesce(json_extract_string(j, '$.narrative'), '') AS narrative,
  nullif(array_to_string(json_extract_string(j, '$.suggested_remediation[*]'), chr(10)), '') AS suggested_remediation,
  coalesce(json_array_length(j, '$.source_evidence'), 0) AS evidence
  FROM (SELECT *, json_extract_string(j, '$.confidence') AS conf FROM parsed)),
steps AS (SELECT response_id, CAST(pos - 1 AS BIGINT) AS pos, chain[pos] AS arn,
  CASE WHEN pos = 1 THEN 'ROOT CAUSE' WHEN pos = len(chain) THEN 'SURFACE' ELSE 'PROPAGATION' END AS role
  FROM (SELECT response_id, chain, unnest(generate_series(1, len(chain))) AS pos FROM rep WHERE len(chain) > 0)),
labelled AS (SELECT s.*, coalesce(g.name, string_split(s.arn, ':')[-1]) AS label, coalesce(g.resource_type, 'unknown') AS service
  FROM steps s LEFT JOIN graph_nodes g USING (arn)),
items AS (SELECT response_id, pos, item, json_type(item) = 'VARCHAR' AS plain
  FROM (SELECT response_id, unnest(json_extract(j, '$.source_evidence[*]')) AS item,
      generate_subscripts(json_extract(j, '$.source_evidence[*]'), 1) - 1 AS pos FROM parsed WHERE j IS NOT NULL)),
evid AS (SELECT response_id, CAST(pos AS BIGINT) AS pos, plain,
  CASE WHEN NOT plain THEN coalesce(json_extract_string(item, '$.source_file'), 'unknown') END AS source_file,
  CASE WHEN plain THEN json_extract_string(item, '$') ELSE coalesce(json_extract_string(item, '$.excerpt'), '') END AS excerpt,
  CASE WHEN NOT plain THEN coalesce(json_extract_string(item, '$.relevance'), '') END AS relevance FROM items)"""


def on_replies(ctes: str, body: str, *more: str) -> str:
    return oracle(f"WITH {ctes} {body}", "responses_v", *more)


def shaped(sql: str, body: str) -> str:
    return f"WITH src AS ({sql}) {body}"


LINES = """SELECT response_id, CAST(section_no AS BIGINT) AS section_no, CAST(item_no AS BIGINT) AS item_no,
    CAST(k - 1 AS BIGINT) AS line_no, ls[k] AS line FROM (SELECT *, unnest(generate_series(1, len(ls))) AS k FROM (
  SELECT response_id, 1 AS section_no, 0 AS item_no, ['# Incident Report', '', 'Confidence: ' || confidence, ''] AS ls FROM rep
  UNION ALL SELECT response_id, 2, 0, ['## Incident Timeline', '', CASE WHEN narrative = '' THEN 'No narrative could be constructed.' ELSE narrative END, ''] FROM rep
  UNION ALL SELECT response_id, 3, -1, CASE WHEN len(chain) > 0 THEN ['## Root Cause Chain', ''] ELSE ['## Root Cause Chain', '', 'No root cause chain identified.', ''] END FROM rep
  UNION ALL SELECT response_id, 3, pos, ['### ' || (pos + 1) || '. ' || label || ' — ' || role, '- ID: `' || arn || '`', ''] FROM labelled
  UNION ALL SELECT response_id, 5, 0, ['## Recommended Action', '', coalesce(suggested_remediation, 'No specific remediation suggested.'), ''] FROM rep
  UNION ALL SELECT response_id, 6, -1, ['## Source Evidence', ''] FROM rep WHERE evidence > 0
  UNION ALL SELECT response_id, 6, pos, CASE WHEN plain THEN ['### Evidence ' || pos, '', excerpt, '']
    ELSE ['### Evidence ' || pos || ': `' || source_file || '`', '', '```', excerpt, '```', ''] END FROM evid))"""

ORACLES = {
    "reply_nodes": on_replies(NODES, """SELECT response_id, arn, coalesce(any_value(t) FILTER (pos = last), 'unknown') AS resource_type,
        coalesce(any_value(n) FILTER (pos = last), string_split(arn, ':')[-1]) AS name
        FROM (SELECT *, max(pos) OVER (PARTITION BY response_id, arn) AS last FROM rnodes) GROUP BY response_id, arn"""),
    "reply_edges": on_replies(NODES, """SELECT response_id, CAST(pos AS BIGINT) AS pos, source_arn, target_arn, relationship FROM redges
        WHERE source_arn IS NOT NULL AND target_arn IS NOT NULL"""),
    "reply_rejects": on_replies(PARSED_CTE, "SELECT response_id, response FROM parsed WHERE j IS NULL"),
    "reply_merge_nodes": on_replies(NODES, "SELECT * FROM graph_nodes UNION ALL SELECT arn, resource_type, name FROM edit_nodes_v",
                                    "edit_nodes_v"),
    "reply_merge_edges": on_replies(NODES, """SELECT source_arn, target_arn, relationship FROM redges
        WHERE source_arn IS NOT NULL AND target_arn IS NOT NULL UNION SELECT * FROM edit_edges_v""", "edit_edges_v"),
    "log_requests": on_replies(PARSED_CTE, """SELECT response_id, CAST(row_number() OVER (PARTITION BY response_id ORDER BY p) - 1 AS BIGINT) AS pos, file_name
        FROM (SELECT response_id, p, CASE WHEN json_type(item) = 'VARCHAR' THEN json_extract_string(item, '$') ELSE
            coalesce(json_extract_string(item, '$.file'), json_extract_string(item, '$.filename'), json_extract_string(item, '$.name'),
              json_extract_string(item, '$.path')) END AS file_name
          FROM (SELECT response_id, unnest(json_extract(j, '$.request_logs[*]')) AS item,
            generate_subscripts(json_extract(j, '$.request_logs[*]'), 1) AS p FROM parsed WHERE j IS NOT NULL)) WHERE file_name IS NOT NULL"""),
    "report_fields": on_replies(REPORT, """SELECT response_id, parsed, confidence, hypothesis, array_to_string(chain, ',') AS root_cause_chain,
        narrative, suggested_remediation, CAST(evidence AS BIGINT) AS evidence FROM rep"""),
    "chain_roles": on_replies(REPORT, "SELECT * FROM steps"),
    "chain_labels": on_replies(REPORT, "SELECT * FROM labelled"),
    "evidence_rows": on_replies(REPORT, "SELECT * FROM evid"),
    "result_summary": on_replies(REPORT, """SELECT response_id, confidence, array_to_string(chain, ' → ') AS chain, narrative AS story,
        suggested_remediation AS remediation, CAST(evidence AS BIGINT) AS evidence_count FROM rep"""),
    "report_lines": on_replies(REPORT, LINES),
    "topology_lines": oracle("WITH " + NODES_CTE + "," + MENTIONS_CTE + "," + SIGNALS_CTE + """
        SELECT CAST(part AS BIGINT) AS part, sort_key, line FROM (
        VALUES (1, '0', '## Topology Overview'), (1, '1', ''), (1, '2', '| Resource | Type | Health |'), (1, '3', '|----------|------|--------|'),
          (3, '0', ''), (3, '1', '| Source | Relationship | Target |'), (3, '2', '|--------|-------------|--------|')) v(part, sort_key, line)
        UNION ALL SELECT 2, arn, '| ' || name || ' | ' || resource_type || ' | ' || status || ' |' FROM nodes JOIN state USING (arn)
        UNION ALL SELECT 4, source_arn || '|' || target_arn || '|' || relationship, '| ' || s.name || ' | ' || relationship || ' | ' || t.name || ' |'
          FROM edges JOIN nodes s ON s.arn = source_arn JOIN nodes t ON t.arn = target_arn""", "findings_v"),
    "reply_actions": shaped(ACTIONS_SQL, r"""SELECT response_id, coalesce(json_extract_string(j, '$.action'), 'respond') AS action,
        json_extract_string(j, '$.tool') AS tool,
        CASE WHEN json_extract_string(j, '$.action') = 'tool' THEN coalesce(json_extract_string(j, '$.params.log_dir'), '/logs') END AS log_dir,
        CAST(json_extract(j, '$.params') AS VARCHAR) AS params,
        CASE WHEN coalesce(json_extract_string(j, '$.action'), 'respond') <> 'tool' THEN coalesce(json_extract_string(j, '$.message'), trim(response)) END AS message
        FROM (SELECT *, CASE WHEN json_valid(regexp_extract(response, '(?s)\{.*\}')) THEN CAST(regexp_extract(response, '(?s)\{.*\}') AS JSON) END AS j FROM src)"""),
    "result_text": """SELECT conv_id * 1000 + turn AS response_id, CASE (conv_id + turn) % 5 WHEN 0 THEN 'answer ' || role WHEN 1 THEN 'plain ' || role
        WHEN 2 THEN 'a ' || role || chr(10) || 'b' || chr(10) WHEN 3 THEN 'coloured' ELSE 'not json ' || role END AS text,
        (conv_id + turn) % 5 <> 4 AS parsed FROM conversations""",
    "reply_text": """SELECT conv_id * 1000 + turn AS response_id, CASE (conv_id + turn) % 3 WHEN 0 THEN role || chr(10) || 'turn ' || turn
        WHEN 1 THEN role || ' without mark' ELSE 'one' || chr(10) || role END AS text FROM conversations""",
}
