"""Queries of this package by name, and SQL that must give the same rows."""

from __future__ import annotations

from sievelake.llm import oracle, queries

QUERIES = {name: f for name, f in vars(queries).items() if name.startswith("op") and name[2].isdigit()} | {"chat_layouts": queries.chat_layouts}
ORACLE = {"chat_layouts": oracle.layouts_sql(), "op3_chat_format": oracle.chat_sql(queries.HOSTILE), "op4_ngram_jaccard_join": oracle.NEAR_DUPLICATES, "op7_url_filter": oracle.url_sql(), "op12_vector_codes": oracle.codes_sql()}
