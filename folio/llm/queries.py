"""Registered queries of this subpackage and their SQL."""

from folio.llm import bpe, chat, exact_dedup, packing, prefix_trie, quality, simhash, substring, suffix_tree, token_counts, topk, warc, whitening  # noqa: F401 - each registers its query
from folio.llm.common import ORACLES, QUERIES  # noqa: F401
