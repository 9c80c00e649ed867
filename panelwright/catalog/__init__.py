"""Registered queries and their SQL equivalents."""

from __future__ import annotations

from panelwright.catalog import audits, basics, books, families, formulas, histories, interface, judging, last, minute_factors, more, paper, refined, relational, report_factors, rest, strategies

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (basics, relational, judging, books, formulas, more, report_factors, rest, last, paper, families, minute_factors, interface, strategies, refined, audits, histories):
    QUERIES |= _part.C.queries
    ORACLE_SQL |= _part.C.oracle
