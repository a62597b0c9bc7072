"""Registered queries of the library and the SQL that checks them."""

from __future__ import annotations

from . import disclosures, evaluate, fundamentals, patterns, regime, review, sectors, streaming, text, windows

MODULES = (windows, patterns, evaluate, review, regime, text, fundamentals, disclosures, streaming, sectors)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
FLAGSHIP = patterns.FLAGSHIP
