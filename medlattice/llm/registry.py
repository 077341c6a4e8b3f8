"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from medlattice.llm import decontaminate, html, jaccard, katz, line_dedup, mixing, quality, secrets, tokens, urls

MODULES = (quality, decontaminate, katz, secrets, tokens, line_dedup, jaccard, html, urls, mixing)


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
