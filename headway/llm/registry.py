"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from headway.llm import bpe, centroids, decontaminate, licenses, merkle, minhash, paragraph_sketch, quality, suffix_array, suffix_tree, tokenfile, urls, warc

MODULES = (suffix_array, minhash, paragraph_sketch, licenses, tokenfile, warc, bpe, quality, decontaminate, suffix_tree, centroids, urls, merkle)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
