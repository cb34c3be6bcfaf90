"""Queries on incremental file work and on usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograph.functions import arn as A
from lograph.functions import checks
from lograph.functions import text as T
from lograph.operators import incremental as I
from lograph.operators import usage as U
from lograph.plans.views import oracle, table, view

CHUNK = 1000


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as log files; the character count stands for the size."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("/logs/"), "source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".log")).alias("path"),
        F.col("n_chars").alias("length"), (F.col("doc_id") * 1000 + F.col("n_chars")).alias("modified_ms"),
    )


def _results(spark, sf_dir):
    """Cached results: one per labelled document; where the label is toxic the file has changed since."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    cached = I.with_fingerprint(files(spark, sf_dir).join(labels, "doc_id").withColumn(
        "modified_ms", F.col("modified_ms") - F.col("toxic")))
    return cached.select("fingerprint", F.col("path").alias("abs_path"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("result"))


def _marked(spark, sf_dir):
    return I.with_fingerprint(files(spark, sf_dir))


def size_gate(spark, sf_dir):
    return I.size_gate(files(spark, sf_dir), 20000).select("path", "length")


def fingerprints(spark, sf_dir):
    return I.with_fingerprint(files(spark, sf_dir), 16).select("path", "fingerprint")


def cache_split(spark, sf_dir):
    return I.cache_split(_marked(spark, sf_dir), _results(spark, sf_dir)).select("path", "cached_result", "hit")


def cache_misses(spark, sf_dir):
    return I.cache_misses(_marked(spark, sf_dir), _results(spark, sf_dir)).select("path")


def cache_store(spark, sf_dir):
    done = _marked(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    rows = I.cache_rows(done.withColumn("result", F.concat(F.lit(" \n"), F.col("text"), F.lit("\n "))))
    return rows.select("abs_path", "file_name", "file_size", F.length("result").cast("bigint").alias("chars"))


def combined_report(spark, sf_dir):
    split = I.cache_split(_marked(spark, sf_dir), _results(spark, sf_dir))
    return I.combined_report(split.select(F.col("doc_id").alias("file_no"), "path", F.col("cached_result").alias("result")))


def _names(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", A.last_part(F.translate("path", "/", ":")).alias("file_name"))


def remaining_files(spark, sf_dir):
    names = _names(spark, sf_dir)
    done = names.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return I.remaining_files(names, done).select("file_name")


def known_requests(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("doc-"), (F.col("conv_id") * 7 + F.col("turn")).cast("string"), F.lit(".log")).alias("file_name"))
    return I.known_requests(asked, _names(spark, sf_dir))


def _states(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("/logs/"), F.col("conv_id").cast("string")).alias("log_dir"), F.lit("timeout").alias("error_pattern"),
        F.col("turn").alias("iteration"), F.length("text").cast("bigint").alias("files"),
        (F.col("role") == "assistant").alias("is_resolved"))


def resume_state(spark, sf_dir):
    return I.resume_state(_states(spark, sf_dir), ["log_dir", "error_pattern"])


def next_state(spark, sf_dir):
    return I.next_state(_states(spark, sf_dir), F.col("files") > 300)


def text_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"), CHUNK)).alias("chunk_no", "chunk"))
    return docs.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"),
                       F.length("chunk").cast("bigint").alias("chars"), F.md5("chunk").alias("digest"))


def human_sizes(spark, sf_dir):
    # Larger keys take the product beyond 64 bits: size is then null, and shown comes from the exact product.
    exact = F.col("l_orderkey").cast("decimal(20,0)") * F.col("l_orderkey").cast("decimal(20,0)") * F.col("l_partkey").cast("decimal(20,0)")
    sizes = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.try_multiply(F.try_multiply(F.col("l_orderkey"), F.col("l_orderkey")), F.col("l_partkey")).alias("size"),
        exact.cast("double").alias("exact"))
    return sizes.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), "size", T.human_size(F.col("exact")).alias("shown"))


def reference_ids(spark, sf_dir):
    """References out of page addresses: bucket, prefix, id, file name and validity."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^http://", "s3://").alias("identifier"))
    bucket = A.bucket_of(F.col("identifier"))
    ref = A.reference_id(F.lit("s3_bucket"), bucket, A.prefix_of(F.col("identifier"), F.lit("none")))
    return pages.select(
        "page_id", bucket.alias("bucket"), A.prefix_of(F.col("identifier"), F.lit("none")).alias("prefix"), ref.alias("unique_id"),
        A.safe_name(ref).alias("file_name"), checks.not_blank(ref).alias("valid"))


def valid_regions(spark, sf_dir):
    places = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat_ws("-", F.element_at(F.array(*[F.lit(x) for x in ("us", "eu", "ap", "us-gov", "xx")]), (F.col("c_custkey") % 5 + 1).cast("int")),
                                F.element_at(F.array(*[F.lit(x) for x in ("east", "northwest", "up")]), (F.col("c_nationkey") % 3 + 1).cast("int")),
                                F.col("c_nationkey").cast("string")).alias("region"))
    return places.select("c_custkey", "region", checks.valid_region(F.col("region")).alias("valid"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "usage_v")


def _money(frame: DataFrame, column: str = "cost") -> DataFrame:
    return frame.withColumn(column, F.round(column, 6).cast("double"))


def call_costs(spark, sf_dir):
    return _money(U.with_cost(calls(spark, sf_dir))).select("conv_id", "turn", "model", "cost")


def session_usage(spark, sf_dir):
    return _money(U.session_usage(calls(spark, sf_dir)))


def context_use(spark, sf_dir):
    return U.context_use(U.session_usage(calls(spark, sf_dir))).select("label", "model", "tokens_used", "context_window", "context_pct")


def run_usage(spark, sf_dir):
    return U.run_usage(U.session_usage(calls(spark, sf_dir)))


def usage_lines(spark, sf_dir):
    return U.usage_lines(U.session_usage(calls(spark, sf_dir))).withColumn("part", F.col("part").cast("bigint"))


OUTPUT_SQL = """
SELECT 'session-' || CAST(conv_id AS STRING) AS label, CASE WHEN conv_id % 4 = 3 THEN '' ELSE 'opus' END AS model, length(text) AS prompt_chars,
  CASE WHEN turn % 4 = 3 THEN 'no json ' || role ELSE '{"result":"' || role || '","usage":{"input_tokens":' || CAST(length(text) AS STRING)
    || ',"output_tokens":' || CAST(turn AS STRING) || '},"duration_ms":' || CAST(turn * 700 AS STRING)
    || CASE WHEN conv_id % 3 = 0 THEN ',"total_cost_usd":0.25' ELSE '' END || '}' END AS raw,
  CASE WHEN turn % 4 = 3 THEN 'no json ' || role ELSE role END AS text
FROM conversations"""


def output_usage(spark, sf_dir):
    """Usage straight out of the commands' JSON output."""
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return _money(U.session_usage(U.call_rows(spark.sql(OUTPUT_SQL))))


CREDIT_SQL = """
SELECT 'session-' || CAST(conv_id AS STRING) AS label, length(text) AS prompt_chars,
  CASE conv_id % 4 WHEN 0 THEN 'claude-opus-4.6' WHEN 1 THEN 'claude-sonnet-4.6-1m' WHEN 2 THEN '' ELSE 'other' END AS model,
  '> ' || role || chr(10) || 'more' AS stdout,
  CASE WHEN turn % 3 = 2 THEN 'nothing' ELSE chr(27) || '[33m▸ Credits: ' || CAST(turn AS STRING) || '.25 Time: ' || CAST(turn * 3 AS STRING) || 's' END AS stderr
FROM conversations"""


def credit_sessions(spark, sf_dir):
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return U.credit_sessions(U.credit_calls(spark.sql(CREDIT_SQL)))


QUERIES = {f.__name__: f for f in [
    size_gate, fingerprints, cache_split, cache_misses, cache_store, combined_report, remaining_files, known_requests, resume_state,
    next_state, text_chunks, human_sizes, reference_ids, valid_regions, call_costs, session_usage, context_use, run_usage, usage_lines, output_usage,
    credit_sessions,
]}

FILES = """
files AS (SELECT doc_id, '/logs/' || source || '/doc-' || doc_id || '.log' AS path, n_chars AS length, doc_id * 1000 + n_chars AS modified_ms FROM documents),
hits AS (SELECT g.*, 'quality ' || quality AS result FROM files g LEFT JOIN labels l ON l.doc_id = g.doc_id AND toxic = 0)"""
COST = """
costed AS (SELECT *, CASE WHEN total_cost_usd <> 0 THEN CAST(total_cost_usd AS DECIMAL(28,10)) ELSE CAST(
    (CAST(input_tokens AS DECIMAL(18,0)) * pin + CAST(output_tokens AS DECIMAL(18,0)) * pout) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(28,10)) END AS cost
  FROM (SELECT * REPLACE (CASE model WHEN 'haiku' THEN 'claude-haiku-4-5' WHEN 'sonnet' THEN 'claude-sonnet-4-6' WHEN 'opus' THEN 'claude-opus-4-6'
      WHEN 'claude-opus-4.6' THEN 'claude-opus-4-6' WHEN '' THEN 'claude-sonnet-4-6' ELSE model END AS model),
      CAST(CASE model WHEN 'haiku' THEN 0.0008 WHEN 'opus' THEN 0.015 WHEN 'claude-opus-4.6' THEN 0.015 ELSE 0.003 END AS DECIMAL(5,4)) AS pin,
      CAST(CASE model WHEN 'haiku' THEN 0.004 WHEN 'opus' THEN 0.075 WHEN 'claude-opus-4.6' THEN 0.075 ELSE 0.015 END AS DECIMAL(5,4)) AS pout FROM {src})),
sessions AS (SELECT label, model, count(*) AS turns, sum(cost) AS cost, CAST(sum(duration_ms // 1000) AS BIGINT) AS total_time_secs,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(input_chars) AS BIGINT) AS input_chars, CAST(sum(output_chars) AS BIGINT) AS output_chars FROM costed GROUP BY label, model)"""
ON_CALLS = COST.replace("{src}", "usage_v")
SESSION_COLUMNS = """label, model, turns, CAST(round(cost, 6) AS DOUBLE) AS cost, total_time_secs, input_tokens, output_tokens,
    input_chars, output_chars"""
DOC = "'doc-' || doc_id || '.log'"
ORACLES = {
    "size_gate": f"WITH {FILES} SELECT path, length FROM files WHERE length > 0 AND length <= 20000",
    "fingerprints": f"WITH {FILES} SELECT path, substr(sha256(path || '|' || length || '|' || modified_ms), 1, 16) AS fingerprint FROM files",
    "cache_split": f"WITH {FILES} SELECT path, result AS cached_result, result IS NOT NULL AS hit FROM hits",
    "cache_misses": f"WITH {FILES} SELECT path FROM hits WHERE result IS NULL",
    "cache_store": rf"""WITH {FILES} SELECT path AS abs_path, {DOC} AS file_name, length AS file_size,
        length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS chars FROM files JOIN documents USING (doc_id)
        WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 0""",
    "combined_report": f"WITH {FILES} SELECT doc_id AS file_no, '=== ' || {DOC} || ' ===' || chr(10) || result AS block FROM hits WHERE result IS NOT NULL",
    "remaining_files": f"SELECT {DOC} AS file_name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "known_requests": """SELECT 'doc-' || (conv_id * 7 + turn) || '.log' AS file_name, conv_id, turn FROM conversations
        WHERE conv_id * 7 + turn IN (SELECT doc_id FROM documents)""",
    "resume_state": """SELECT '/logs/' || conv_id AS log_dir, 'timeout' AS error_pattern, max(turn) AS iteration,
        CAST(arg_max(length(text), turn) AS BIGINT) AS files, false AS is_resolved FROM conversations
        GROUP BY conv_id HAVING arg_max(role, turn) <> 'assistant'""",
    "next_state": """SELECT '/logs/' || conv_id AS log_dir, 'timeout' AS error_pattern, turn + 1 AS iteration, length(text) AS files,
        length(text) > 300 AS is_resolved FROM conversations""",
    "text_chunks": f"""SELECT doc_id, i AS chunk_no, length(c) AS chars, md5(c) AS digest FROM (SELECT doc_id, i, substr(text, i * {CHUNK} + 1, {CHUNK}) AS c
        FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(CAST(ceil(length(text) / {CHUNK}) AS BIGINT) - 1, 0))) AS i FROM documents))""",
    "human_sizes": """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, size, CASE WHEN s < 1024 THEN printf('%.1fB', s)
        WHEN s < 1048576 THEN printf('%.1fKB', s / 1024) WHEN s < 1073741824 THEN printf('%.1fMB', s / 1048576)
        WHEN s < 1099511627776 THEN printf('%.1fGB', s / 1073741824) ELSE printf('%.1fTB', s / 1099511627776) END AS shown
        FROM (SELECT *, CAST(size AS DOUBLE) AS s FROM (SELECT l_orderkey, l_linenumber, l_orderkey * l_orderkey * l_partkey AS size FROM lineitem))""",
    "reference_ids": """SELECT page_id, bucket, prefix, 's3_bucket:' || bucket || ':' || prefix AS unique_id,
        replace(replace('s3_bucket:' || bucket || ':' || prefix, ':', '_'), '/', '_') AS file_name, true AS valid
        FROM (SELECT page_id, string_split(u, '/')[1] AS bucket, CASE WHEN contains(u, '/') THEN substr(u, strpos(u, '/') + 1) ELSE 'none' END AS prefix
          FROM (SELECT page_id, replace(url, 'http://', '') AS u FROM pages))""",
    "valid_regions": """SELECT c_custkey, a || '-' || d || '-' || c_nationkey AS region, a IN ('us', 'eu', 'ap') AND d <> 'up' AS valid
        FROM (SELECT *, ['us', 'eu', 'ap', 'us-gov', 'xx'][c_custkey % 5 + 1] AS a, ['east', 'northwest', 'up'][c_nationkey % 3 + 1] AS d FROM customer)""",
    "call_costs": oracle(f"WITH {ON_CALLS} SELECT conv_id, turn, model, CAST(round(cost, 6) AS DOUBLE) AS cost FROM costed", "usage_v"),
    "session_usage": oracle(f"WITH {ON_CALLS} SELECT {SESSION_COLUMNS} FROM sessions", "usage_v"),
    "context_use": oracle(f"""WITH {ON_CALLS} SELECT label, model, used AS tokens_used, 200000 AS context_window,
        round_even(used * 100.0e0 / 200000, 1) AS context_pct
        FROM (SELECT *, CASE WHEN input_tokens + output_tokens <> 0 THEN input_tokens + output_tokens ELSE (input_chars + output_chars) // 4 END AS used
          FROM sessions)""", "usage_v"),
    "run_usage": oracle(f"""WITH {ON_CALLS} SELECT model, label, count(*) AS sessions, CAST(round(sum(cost), 2) AS DOUBLE) AS credits,
        CAST(sum(total_time_secs) AS BIGINT) AS seconds, CAST(sum(turns) AS BIGINT) AS turns, CAST(grouping(model, label) AS BIGINT) AS level
        FROM sessions GROUP BY ROLLUP (model, label)""", "usage_v"),
    "usage_lines": oracle(f"""WITH {ON_CALLS} SELECT CAST(p AS BIGINT) AS part, '' AS label, '' AS model, line FROM (SELECT
          ['  Total sessions: ' || count(*), printf('  Total cost:     $%.4f', CAST(sum(cost) AS DOUBLE)),
           '  Total time:     ' || CAST(sum(total_time_secs) AS BIGINT) || 's', '  Total turns:    ' || CAST(sum(turns) AS BIGINT)] AS ls FROM sessions),
          LATERAL (SELECT unnest(ls) AS line, unnest([0, 1, 2, 3]) AS p)
        UNION ALL SELECT 9, label, model, printf('  %s (%s): $%.4f, %d turns, %ds, %din/%dout tokens', label, model, CAST(cost AS DOUBLE), turns,
          total_time_secs, input_tokens, output_tokens) FROM sessions""", "usage_v"),
    "output_usage": f"""WITH raw AS (SELECT conv_id, turn, 'session-' || conv_id AS label, CASE WHEN conv_id % 4 = 3 THEN '' ELSE 'opus' END AS model, length(text) AS input_chars,
          turn % 4 <> 3 AS ok, length(text) AS n, role FROM conversations),
        o AS (SELECT label, model, input_chars, CASE WHEN ok THEN n ELSE 0 END AS input_tokens, CASE WHEN ok THEN turn ELSE 0 END AS output_tokens,
          CASE WHEN ok THEN turn * 700 ELSE 0 END AS duration_ms, CASE WHEN ok AND conv_id % 3 = 0 THEN 0.25e0 ELSE 0e0 END AS total_cost_usd,
          CASE WHEN ok THEN length(role) ELSE length('no json ' || role) END AS output_chars FROM raw),
        {COST.replace("{src}", "o")} SELECT {SESSION_COLUMNS} FROM sessions""",
    "credit_sessions": """WITH c AS (SELECT 'session-' || conv_id AS label, length(text) + length(role) + 5 AS chars,
          CASE conv_id % 4 WHEN 0 THEN 'claude-opus-4.6' WHEN 1 THEN 'claude-sonnet-4.6-1m' WHEN 2 THEN 'auto' ELSE 'other' END AS model,
          CASE WHEN turn % 3 = 2 THEN 0 ELSE turn + 0.25 END AS credits, CASE WHEN turn % 3 = 2 THEN 0 ELSE turn * 3 END AS secs FROM conversations),
        s AS (SELECT label, model, count(*) AS turns, CAST(sum(credits) AS DOUBLE) AS total_credits, CAST(sum(secs) AS BIGINT) AS total_time_secs,
          CAST(sum(chars) AS BIGINT) // 4 AS by_chars, CASE model WHEN 'claude-opus-4.6' THEN 2.2e0 WHEN 'claude-sonnet-4.6-1m' THEN 1.3e0 ELSE 1e0 END AS credit_multiplier,
          CASE model WHEN 'claude-sonnet-4.6-1m' THEN 1000000 ELSE 200000 END AS context_window FROM c GROUP BY label, model)
        SELECT label, model, credit_multiplier, turns, round(total_credits, 2) AS total_credits, total_time_secs,
          greatest(CAST(floor(total_credits / credit_multiplier * 10000) AS BIGINT), by_chars) AS est_tokens_used, context_window,
          round_even(greatest(CAST(floor(total_credits / credit_multiplier * 10000) AS BIGINT), by_chars) * 100.0e0 / context_window, 1) AS context_pct FROM s""",
}
