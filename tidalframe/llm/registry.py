"""Queries of this folder and their SQL, for the entry module."""

from __future__ import annotations

from . import chat, collocations, fingerprints, jaccard, language, mixing, packing, paragraphs, quality, secrets, sharding, spelling, topk

_MODULES = (secrets, fingerprints, paragraphs, mixing, quality, topk, language, jaccard, packing, sharding, collocations, spelling, chat)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
