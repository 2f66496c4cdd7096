"""All queries of the library outside ``llm``, and their SQL."""

from __future__ import annotations

from . import association, details, domain, files, mixed, preparation

FLAGSHIP = "lm_scan"
_MODULES = [association, details, domain, files, mixed, preparation]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
