"""Operators for training-data pipelines over documents, pages and embeddings.

Nothing else in the library imports this subpackage. Every operator takes and returns DataFrames;
what has to be computed once is written to the shared folder that the session names.
"""
