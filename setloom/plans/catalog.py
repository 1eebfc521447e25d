"""Imports every query module so that the registry is complete."""

from setloom.plans import bundle_queries, case_queries, completion_queries, description_queries, file_queries, io_queries, more_queries, run_queries, sql_queries, text_queries, vector_queries  # noqa: F401

FLAGSHIP = "completion_direct_confidence"
