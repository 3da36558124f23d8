"""Operators for training-data pipelines over a corpus of documents.

Each module holds one operator; ``catalog`` registers the queries. Nothing else
in the library imports this subpackage.
"""
