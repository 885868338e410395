"""All queries outside the optional subpackage."""

from __future__ import annotations

from skosloom.plans import queries_core, queries_hierarchy, queries_lexicon, queries_similarity

_MODULES = (queries_lexicon, queries_similarity, queries_hierarchy, queries_core)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
