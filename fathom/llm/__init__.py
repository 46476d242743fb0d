"""Training-data operators: thirteen DataFrame operators over documents, pages, vectors and labels.

Nothing else in the library imports this subpackage; the queries are in ``queries.py``.
"""
