"""lograph: operational log analytics and service dependency graphs as Spark jobs.

Every operator takes DataFrames and returns DataFrames. Nothing is collected: actions happen only
in the sinks, in the streaming writers and once per hop in the graph traversal.
"""
