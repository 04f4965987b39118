"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from waymark.llm import audio, bytebpe, classifier, jaccard, license, mixing, repetition, substring, tokencounts, tokenids

MODULES = (audio, repetition, bytebpe, jaccard, substring, mixing, tokenids, license, tokencounts, classifier)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in getattr(m, "ORACLE", {}).items()}
