"""All queries of this subpackage."""

from __future__ import annotations

from framesleuth.llm import cross_tokens, decontaminate, embed_dedup, html_text, importance, katz, licenses, minhash, packing, personal, quality, tokens, toxicity  # noqa: F401
from framesleuth.llm.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
