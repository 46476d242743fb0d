"""All queries of the library, by name."""

from . import batch, catalogue, chunking, corpus, evaluation, evidence, governance, records, retrieval, text  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
