"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import url_filter
from .bpe import op8_bpe
from .chat import op2_chat_formatting
from .decontaminate import op9_benchmark_decontamination
from .embedding_dedup import op6_embedding_near_dedup
from .licenses import op10_license_scan
from .line_dedup import op1_line_dedup
from .quality import op7_quality_classifier
from .simhash import op5_simhash_near_dedup
from .token_counts import op3_token_counts

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_token_counts": op3_token_counts,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_bpe": op8_bpe,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_license_scan": op10_license_scan,
}

# The others are iterative, or hash and merge in ways that SQL has no functions for: the tests
# hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op4_url_filter": url_filter.ORACLE}
