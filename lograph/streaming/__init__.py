"""Structured Streaming jobs: the batch operators over ``readStream``.

Each micro-batch writes a folder of its own, ``batch=<id>``. A batch that runs again after a failure
replaces its folder, so nothing counts twice.
"""
