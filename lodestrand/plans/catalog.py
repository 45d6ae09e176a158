"""All registered queries of the engine and their SQL."""

from . import answer_queries, file_queries, graph_queries, kept_queries, more_queries, retrieval_queries, service_queries, stream_queries, text_queries, web_queries  # noqa: F401
from .registered import QUERIES, SQL  # noqa: F401
