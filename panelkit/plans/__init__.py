"""Registered end-to-end queries over the proxy tables, each with its SQL oracle.

``registry.QUERIES[name](spark, sf_dir) -> DataFrame`` and
``registry.ORACLES[name] -> str`` (DuckDB/ANSI SQL over the raw tables).
"""
