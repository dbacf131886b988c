"""All queries of the corpus operators."""

from sparkdraft.llm import (  # noqa: F401
    clustering,
    exact_dedup,
    html_text,
    language,
    license_scan,
    mixing,
    packing,
    prefix_trie,
    quality,
    simhash,
    token_counts,
    url_filter,
    warc,
)
from sparkdraft.llm.common import QUERIES

__all__ = ["QUERIES"]
