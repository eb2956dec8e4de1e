"""Registered queries over the driver tables (``catalog``) and their DuckDB
oracle SQL (``oracle``)."""
