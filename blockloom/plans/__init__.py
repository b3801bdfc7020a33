"""Registered queries, grouped by theme: each module has QUERIES and ORACLE_SQL."""
