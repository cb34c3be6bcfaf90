"""All registered queries, each with its oracle SQL where there is one."""

from __future__ import annotations

from lograph.plans import (
    edit_queries, event_queries, file_queries, flagship, graph_queries, ledger_queries, reply_queries, sink_queries, stream_queries, work_queries,
)

MODULES = [
    flagship, graph_queries, ledger_queries, edit_queries, reply_queries, work_queries, event_queries, file_queries, sink_queries, stream_queries,
]

QUERIES = {name: run for module in MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
