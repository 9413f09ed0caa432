"""Queries of the library; importing this registers all of them."""

from slidegrid.plans import file_queries, model_queries, object_queries, pixel_queries, table_queries  # noqa: F401
