"""The engine's query catalogue: query name -> callable, and its SQL twin."""

from __future__ import annotations

from quillspark.plans import assembled, balancing, extras, judging, reports, rewards, texts

QUERIES = {}
ORACLE_SQL = {}
for _part in (reports, judging, rewards, texts, balancing, extras, assembled):
    QUERIES |= _part.CATALOGUE.queries
    ORACLE_SQL |= _part.CATALOGUE.sql
