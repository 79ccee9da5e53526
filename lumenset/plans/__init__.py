"""Registered queries on the given tables, each with the SQL that checks it where SQL can."""

from . import catalog, cleaning, feeds, profiling, sources, streaming

MODULES = [cleaning, profiling, catalog, feeds, sources, streaming]


def all_queries():
    return {name: build for module in MODULES for name, build in module.QUERIES.items()}


def all_sql():
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
