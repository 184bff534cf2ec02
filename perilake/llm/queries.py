"""All registered queries of the subpackage and the SQL of those that SQL can express."""

from perilake.llm import (  # noqa: F401
    conversation_repair,
    decontamination,
    hard_negatives,
    html_extraction,
    line_dedup,
    license_scan,
    mixing,
    ngram_join,
    quality,
    secret_scan,
    substring_dedup,
    token_counts,
    vector_search,
)
from perilake.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
