"""Loads the modules that register this folder's queries."""

from . import ann, chat, collocations, decontaminate, jaccard_join, lm_scoring, mixing, piece_bpe, suffix_dedup, token_alignment, token_counts, toxicity, url_filter  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
