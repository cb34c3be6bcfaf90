"""Queries on triggers, log lines and the dependency graph's traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from lograph.operators import findings as N
from lograph.operators import search as K
from lograph.operators import templates as P
from lograph.operators import trace as R
from lograph.operators import triggers as T
from lograph.operators.health import health_signals
from lograph.plans.graph_queries import SIGNALS_CTE
from lograph.plans.views import oracle, table, view, with_arrays
from lograph.session import scratch_path
from lograph.sources import records as S

SURFACE = "order-3"
CHAIN = 30
ROOT = "nation-3"
GAP = "2 hours"


def trigger_route(spark, sf_dir):
    return T.route_triggers(view(spark, sf_dir, "triggers_v"))


def lines(spark, sf_dir):
    return view(spark, sf_dir, "loglines_v")


def line_findings(spark, sf_dir):
    return N.line_findings(lines(spark, sf_dir)).select(
        "line_no", "ts", "file_name", "severity", F.array_join("resource_arns", ",").alias("arns"),
        F.array_join("addresses", ",").alias("addresses"), "written_time")


def file_digest(spark, sf_dir):
    return N.file_digest(lines(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint"))


def file_overview(spark, sf_dir):
    return N.file_overview(lines(spark, sf_dir))


def rank_files(spark, sf_dir):
    return N.rank_files(lines(spark, sf_dir), "OutOfMemory")


def recent_errors(spark, sf_dir):
    return N.recent_errors(lines(spark, sf_dir), 24)


def timeline(spark, sf_dir):
    return N.timeline(lines(spark, sf_dir))


def incidents(spark, sf_dir):
    return N.incidents(health_signals(with_arrays(view(spark, sf_dir, "findings_v"))), GAP)


SEARCH = "OutOfMemory killed from 10"


def _index(spark, sf_dir, name):
    """The lines as files of an hour each, indexed in two batches."""
    root = scratch_path(spark, name)
    hourly = lines(spark, sf_dir).select(F.concat(F.date_format("ts", "yyyy-MM-dd-HH/"), "file_name").alias("file_name"), "line_no", "line")
    for batch, odd in (("even", 0), ("odd", 1)):
        K.index_batch(hourly.where(F.substring("file_name", 13, 1).cast("int") % 2 == odd), root, batch)
    return root


def search_files(spark, sf_dir):
    """All files that hold a word of the query, with their scores."""
    return K.search_files(spark, _index(spark, sf_dir, "search"), SEARCH).withColumn("score", F.round("score", 6))


def search_best(spark, sf_dir):
    """The best scores only, found without scoring all blocks."""
    return K.search_files(spark, _index(spark, sf_dir, "search_best"), SEARCH, 10).select(F.round("score", 6).alias("score"))


def search_phrase(spark, sf_dir):
    """Files in which the words of a query follow each other, and how often."""
    return K.search_files(spark, _index(spark, sf_dir, "phrase"), "outofmemory killed from", phrase=True).select("file_name", "hits")


def mined_templates(spark, sf_dir):
    return P.mined_templates(lines(spark, sf_dir), 2).drop("template_id")


def template_digest(spark, sf_dir):
    """Templates of each file, mined over all files."""
    found = lines(spark, sf_dir)
    return P.template_digest(found, P.mined_templates(found, 2), 2).drop("template_id")


def graph_frames(spark, sf_dir):
    health = view(spark, sf_dir, "graph_health_v")
    return view(spark, sf_dir, "graph_v"), health


def root_cause_trace(spark, sf_dir):
    edges, health = graph_frames(spark, sf_dir)
    return R.root_cause_trace(edges, health, SURFACE)


def long_trace(spark, sf_dir):
    """A chain of failing parts behind an order, longer than any graph of the tables."""
    edges, health = graph_frames(spark, sf_dir)
    parts = table(spark, sf_dir, "part").where(f"p_partkey <= {CHAIN}").select("p_partkey")
    chain = parts.select(
        F.when(F.col("p_partkey") == 1, SURFACE).otherwise(F.concat(F.lit("part-"), (F.col("p_partkey") - 1).cast("string"))).alias("source_arn"),
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("target_arn"), F.lit("depends_on").alias("relationship"))
    failing = chain.select(F.col("target_arn").alias("arn"), F.lit("error").alias("status"))
    return R.root_cause_trace(edges.unionByName(chain), health.unionByName(failing), SURFACE)


def affected_resources(spark, sf_dir):
    edges, _ = graph_frames(spark, sf_dir)
    return R.affected_resources(edges, ROOT)


RECORDS_SQL = """
SELECT event_id AS seq, CASE event_type WHEN 'view' THEN '{"source_file":"a.log","severity":"fatal","message":"m"}'
  WHEN 'click' THEN '{"source_file":"' || CAST(user_id AS STRING) || '.log","severity":"info","message":"m"}'
  WHEN 'signup' THEN 'broken' ELSE '{"source_file":"b.log","timestamp":"2024-03-01T10:00:00","severity":"error","message":"' || event_type
    || '","resource_arns":["x","' || CAST(user_id AS STRING) || '"]}' END AS json FROM events"""


def _records(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return S.findings(spark.sql(RECORDS_SQL), F.expr("timestamp_ntz '2024-01-01 00:00:00'"))


def finding_records(spark, sf_dir):
    good, _ = _records(spark, sf_dir)
    return good.select("seq", "source_file", "ts", "severity", "message", F.array_join("resource_arns", ",").alias("arns"))


def finding_rejects(spark, sf_dir):
    _, bad = _records(spark, sf_dir)
    return bad.select("seq", F.array_join("errors", ",").alias("errors"))


QUERIES = {f.__name__: f for f in [
    finding_records, finding_rejects, trigger_route, line_findings, file_digest, file_overview, rank_files, recent_errors, timeline, root_cause_trace,
    long_trace, affected_resources, incidents, mined_templates, template_digest, search_files, search_best, search_phrase,
]}

# The lines hold one word for the severity and one for the cause.
SEVERITY = """CASE WHEN contains(line, 'FATAL') OR contains(line, 'OutOfMemory') THEN 'critical'
  WHEN contains(line, '[ERROR]') OR contains(line, 'denied') THEN 'error'
  WHEN contains(line, 'WARN:') OR contains(line, 'timeout') THEN 'warning' ELSE 'info' END"""
SEVERE = f"l AS (SELECT *, {SEVERITY} AS severity FROM loglines_v)"
# A node enters once: a later, longer way to it does not replace the first.
BFS = """
seen(arn, depth) USING KEY (arn) AS (SELECT '{start}', 0 UNION SELECT e.{far}, min(w.depth) + 1 FROM seen w JOIN {graph} e ON e.{near} = w.arn
  WHERE e.{far} NOT IN (SELECT arn FROM recurring.seen) GROUP BY e.{far})"""
# A tree of two tokens: lines by number of tokens, then the first two; a position that differs is a wildcard.
MINED = SEVERE + r""",
w AS (SELECT file_name, severity, string_split(regexp_replace(regexp_replace(line, 'arn:aws[a-z0-9_-]*:[^ ]+', '<arn>', 'g'), '[0-9]+', '#', 'g'), ' ') AS t FROM l),
k AS (SELECT *, len(t) AS n, t[1] AS a, t[2] AS b FROM w),
p AS (SELECT n, a, b, i, CASE WHEN min(x) = max(x) THEN min(x) ELSE '<*>' END AS x FROM (
  SELECT n, a, b, unnest(generate_series(1, n)) AS i, unnest(t) AS x FROM (SELECT DISTINCT n, a, b, t FROM k)) GROUP BY ALL),
m AS (SELECT n, a, b, string_agg(x, ' ' ORDER BY i) AS template, count(*) FILTER (x = '<*>') AS wildcards FROM p GROUP BY ALL)"""


BM25 = r"""
h AS (SELECT strftime(ts, '%Y-%m-%d-%H/') || file_name AS file_name, list_filter(regexp_split_to_array(lower(line), '[^\p{L}\p{N}_]+'), lambda w: w <> '') AS w FROM loglines_v),
o AS (SELECT file_name, unnest(w) AS term FROM h),
c AS (SELECT file_name, term, count(*) AS times FROM o GROUP BY ALL),
d AS (SELECT file_name, sum(times) AS length FROM c GROUP BY ALL),
g AS (SELECT count(*) AS n, avg(length) AS average FROM d),
q AS (SELECT term, count(*) AS df FROM c WHERE term IN ('outofmemory', 'killed', 'from', '10') GROUP BY ALL),
s AS (SELECT file_name, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * length / average))) AS score
  FROM c JOIN q USING (term) JOIN d USING (file_name), g GROUP BY file_name)"""


def trace_sql(graph: str, health: str) -> str:
    return oracle("WITH RECURSIVE " + BFS.format(start=SURFACE, near="source_arn", far="target_arn", graph=graph) + f""",
        g AS (SELECT * FROM {graph}), bad AS (SELECT arn FROM {health} WHERE status = 'error'),
        cand AS (SELECT *, NOT EXISTS (SELECT 1 FROM g e JOIN bad b ON b.arn = e.target_arn WHERE e.source_arn = s.arn
          AND e.target_arn <> s.arn) AS clean FROM seen s WHERE arn IN (SELECT arn FROM bad)),
        root AS (SELECT arn, depth FROM cand ORDER BY clean DESC, depth DESC, arn LIMIT 1),
        back AS (SELECT e.target_arn AS arn, min(e.source_arn) AS via FROM g e JOIN seen s ON s.arn = e.source_arn JOIN seen t ON t.arn = e.target_arn
          WHERE s.depth = t.depth - 1 GROUP BY 1),
        chain AS (SELECT arn, depth FROM root UNION ALL SELECT b.via, c.depth - 1 FROM chain c JOIN back b ON b.arn = c.arn WHERE c.depth > 0)
        SELECT CAST((SELECT depth FROM root) - depth AS BIGINT) AS position, arn, CAST(depth AS BIGINT) AS hops_from_surface,
          CASE WHEN depth = (SELECT depth FROM root) THEN 'ROOT CAUSE' WHEN depth = 0 THEN 'SURFACE' ELSE 'PROPAGATION' END AS role FROM chain""",
        "graph_v", "graph_health_v")


ORACLES = {
    "finding_records": """SELECT event_id AS seq, CASE event_type WHEN 'click' THEN user_id || '.log' ELSE 'b.log' END AS source_file,
        CASE event_type WHEN 'click' THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-03-01 10:00:00' END AS ts,
        CASE event_type WHEN 'click' THEN 'info' ELSE 'error' END AS severity, CASE event_type WHEN 'click' THEN 'm' ELSE event_type END AS message,
        CASE event_type WHEN 'click' THEN '' ELSE 'x,' || user_id END AS arns FROM events WHERE event_type NOT IN ('view', 'signup')""",
    "finding_rejects": """SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'bad_severity' ELSE 'bad_severity,blank_file,no_message' END AS errors
        FROM events WHERE event_type IN ('view', 'signup')""",
    "trigger_route": oracle("""WITH k AS (SELECT event_id, CAST(event AS JSON) AS j FROM triggers_v),
        c AS (SELECT *, json_exists(j, '$.Records[0].s3') AS st, NOT json_exists(j, '$.Records[0].s3') AND json_exists(j, '$.source')
          AND json_exists(j, '$.detail') AS al FROM k)
        SELECT event_id, CASE WHEN st THEN 's3_event' WHEN al THEN 'cloudwatch_event' ELSE 'unknown' END AS trigger_type,
          CASE WHEN st THEN coalesce(json_extract_string(j, '$.Records[0].s3.bucket.name'), '') END AS bucket,
          CASE WHEN st THEN coalesce(json_extract_string(j, '$.Records[0].s3.object.key'), '') END AS key,
          CASE WHEN al THEN json_extract_string(j, '$.source') END AS event_source,
          CASE WHEN al THEN json_extract_string(j, '$.detail.resourceArn') END AS target_arn,
          CASE WHEN al THEN json_extract_string(j, '$.detail.errorPattern') END AS error_pattern,
          CASE WHEN al AND json_extract_string(j, '$.detail.errorPattern') <> '' THEN 'error_root_cause' ELSE 'topology_update' END AS tool
        FROM c""", "triggers_v"),
    "line_findings": oracle(f"""WITH {SEVERE} SELECT line_no, ts, file_name, severity, regexp_extract(line, 'arn:aws:[^ ]*') AS arns,
        regexp_extract(line, '[0-9.]+$') AS addresses, CAST(NULL AS VARCHAR) AS written_time FROM l""", "loglines_v"),
    "file_digest": oracle(f"""WITH {SEVERE}, t AS (SELECT file_name, severity, regexp_replace(regexp_replace(line, 'arn:aws[a-z0-9_-]*:[^ ]+', '<arn>', 'g'), '[0-9]+', '#', 'g') AS template, count(*) AS lines
        FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY lines DESC, severity, template) AS rank FROM t)
        SELECT file_name, severity, template, lines, rank FROM r""", "loglines_v"),
    "file_overview": oracle(f"""WITH {SEVERE} SELECT file_name, count(*) AS lines, count(*) FILTER (severity = 'critical') AS critical_lines,
        count(*) FILTER (severity = 'error') AS error_lines, count(DISTINCT regexp_extract(line, 'arn:aws:[^ ]*')) AS resources
        FROM l GROUP BY 1""", "loglines_v"),
    "rank_files": oracle("""SELECT file_name, count(*) AS hits FROM loglines_v WHERE contains(line, 'OutOfMemory') GROUP BY 1
        ORDER BY 2 DESC, 1""", "loglines_v"),
    "recent_errors": oracle(f"""WITH {SEVERE} SELECT line_no, ts, file_name, line, severity FROM l WHERE severity IN ('error', 'critical')
        AND ts >= (SELECT max(ts) - INTERVAL 24 HOUR FROM l)""", "loglines_v"),
    "search_files": oracle(f"WITH {BM25} SELECT file_name, round(score, 6) AS score FROM s", "loglines_v"),
    "search_best": oracle(f"WITH {BM25} SELECT round(score, 6) AS score FROM s ORDER BY s.score DESC LIMIT 10", "loglines_v"),
    "search_phrase": oracle("""SELECT strftime(ts, '%Y-%m-%d-%H/') || file_name AS file_name, count(*) AS hits FROM loglines_v
        WHERE contains(line, 'OutOfMemory killed from') GROUP BY 1""", "loglines_v"),
    "mined_templates": oracle(f"""WITH {MINED} SELECT template, n AS n_tokens, any_value(wildcards) AS wildcards, count(DISTINCT t) AS variants, count(*) AS lines,
        count(DISTINCT file_name) AS files, count(*) FILTER (severity IN ('error', 'critical')) AS error_lines, count(*) FILTER (severity = 'warning') AS warning_lines
        FROM k JOIN m USING (n, a, b) GROUP BY n, a, b, template""", "loglines_v"),
    "template_digest": oracle(f"WITH {MINED} SELECT file_name, template, count(*) AS lines FROM k JOIN m USING (n, a, b) GROUP BY n, a, b, file_name, template", "loglines_v"),
    "incidents": oracle(f"""WITH {SIGNALS_CTE}, b AS (SELECT *, lag(ts) OVER (PARTITION BY arn ORDER BY ts, seq, pos) AS prior FROM signals WHERE r > 0),
        i AS (SELECT *, sum(CASE WHEN prior IS NULL OR ts - prior > INTERVAL {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY arn ORDER BY ts, seq, pos) AS n FROM b)
        SELECT arn, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS signals, count(*) FILTER (r = 2) AS errors,
          CASE max(r) WHEN 2 THEN 'error' ELSE 'warning' END AS status, arg_min(message, seq * 2 + pos) FILTER (r = 2) AS first_error
        FROM i GROUP BY arn, n""", "findings_v"),
    "timeline": oracle(f"""WITH {SEVERE} SELECT date_trunc('hour', ts) AS window_start, severity, count(*) AS lines, min(ts) AS first_ts,
        max(ts) AS last_ts FROM l GROUP BY ALL""", "loglines_v"),
    "root_cause_trace": trace_sql("graph_v", "graph_health_v"),
    "long_trace": trace_sql(f"""(SELECT * FROM graph_v UNION ALL SELECT CASE p_partkey WHEN 1 THEN '{SURFACE}' ELSE 'part-' || (p_partkey - 1) END,
        'part-' || p_partkey, 'depends_on' FROM part WHERE p_partkey <= {CHAIN})""",
        f"(SELECT * FROM graph_health_v UNION ALL SELECT 'part-' || p_partkey, 'error' FROM part WHERE p_partkey <= {CHAIN})"),
    "affected_resources": oracle("WITH RECURSIVE " + BFS.format(start=ROOT, near="target_arn", far="source_arn", graph="graph_v") + """
        SELECT arn, CAST(depth AS BIGINT) AS hops FROM seen WHERE depth > 0""", "graph_v"),
}
