"""Whole jobs, and the catalog of queries with their SQL counterparts."""
