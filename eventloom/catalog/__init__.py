"""Registered queries of the library and the SQL that states their results."""

from . import evidence, extra, filters, identity, ingest, ranking, search, state, streams

_MODULES = (search, filters, ranking, state, identity, extra, evidence, ingest, streams)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
