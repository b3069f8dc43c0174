"""Queries over the operators of this subpackage by name, and the SQL that states the same result where SQL can."""

from __future__ import annotations

from probatum.llm import queries_linkage, queries_names, queries_scans, queries_sizes, queries_subjects, queries_visual

_MODULES = (queries_names, queries_visual, queries_linkage, queries_scans, queries_sizes, queries_subjects)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
