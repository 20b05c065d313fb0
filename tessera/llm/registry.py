"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import attribution, bitplanes, bpe_tree, class_lm, media, packing, quality, secrets, simhash, suffix_dedup

MODULES = (bitplanes, media, class_lm, suffix_dedup, simhash, bpe_tree, attribution, quality, secrets, packing)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
