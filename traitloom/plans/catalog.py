"""Registered queries and their SQL."""

from . import cluster_queries, pixel_queries, record_queries

PARTS = (pixel_queries, record_queries, cluster_queries)
QUERIES: dict = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL: dict = {k: v for p in PARTS for k, v in p.ORACLE_SQL.items()}
