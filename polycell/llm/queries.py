"""The registered queries opN_<name> of this folder's operators and their SQL."""

from __future__ import annotations

from . import bpe, chat, licenses, mixing, ngram_jaccard, paragraphs, topk, toxicity, vectors, warc

_MODULES = (warc, ngram_jaccard, paragraphs, chat, vectors, licenses, mixing, bpe, topk, toxicity)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
