"""Properties of the physical plans that matter at scale."""

import re

import pytest

from conftest import SF_DIR
from lograph.plans.catalog import QUERIES

# These run jobs of their own while they build the result.
EAGER = {n for n in QUERIES if n.startswith("stream_")} | {"topology_job", "snapshot_round_trip", "root_cause_trace", "long_trace", "affected_resources",
    "topology_replay", "ingest_outcome", "edit_job", "stored_history", "stored_dot", "stored_graphml", "ledger_table", "ledger_restore_job",
    "search_files", "search_best", "search_phrase", "resource_map", "report_files", "artifacts"}
# The one reader that works in Python.
ARCHIVES = {"docx_lines"}


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return explained(QUERIES[name](spark, SF_DIR))


def explained(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER - ARCHIVES))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "MapInPandas" not in text


def test_top_rows_per_file_are_cut_before_the_shuffle(spark):
    from lograph.operators import findings
    from lograph.plans import event_queries
    from lograph.plans.views import view

    assert event_queries.lines(spark, SF_DIR).columns == view(spark, SF_DIR, "loglines_v").columns
    text = explained(findings.file_digest(event_queries.lines(spark, SF_DIR), top=5))
    assert text.count("WindowGroupLimit") == 2


def test_filters_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan(spark, "ledger_since"))
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(o_orderdate", plan(spark, "ledger_expired"))


def test_scans_read_only_what_is_used(spark):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "graph_nodes"))
    assert schemas and all("props" not in s and "value" not in s for s in schemas)


def test_graph_is_folded_before_it_is_shuffled(spark):
    text = plan(spark, "graph_edges")
    assert text.count("Exchange hashpartitioning") == 1 and "partial_min" in text


def test_running_values_shuffle_by_key_and_block(spark):
    text = plan(spark, "health_audit")
    assert "hashpartitioning(arn" in text and "__block" in text
    # Windows over the findings themselves are always split by block.
    for spec in re.findall(r"windowspecdefinition\(([^)]*seq#[^)]*)\)", text):
        assert "__block" in spec


def test_health_folds_before_it_meets_the_nodes(spark):
    text = plan(spark, "health_state")
    assert "partial_max" in text and "partial_max_by" in text
