"""All queries of the core library by name, and the SQL that states the same result."""

from __future__ import annotations

from probatum.plans import ledgers, libraries, manuscripts, packing, texts, verify

_MODULES = (verify, ledgers, texts, manuscripts, libraries, packing)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
