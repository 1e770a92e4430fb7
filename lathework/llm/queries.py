"""Queries of the llm subpackage and their SQL."""

from __future__ import annotations

from lathework.llm import q_conversations, q_identifiers, q_pages, q_pairs, q_sentences, q_sizes

MODULES = [q_pairs, q_identifiers, q_pages, q_conversations, q_sizes, q_sentences]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
