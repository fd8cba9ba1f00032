"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op6_byte_bpe
from .hamming_index import op3_hamming_index
from .html_text import op10_html_text
from .near_dup import op8_near_dup
from .packing import op2_packing
from .pii import op4_pii
from .quality import op7_quality
from .sharding import op5_sharding
from .suffix_dedup import op9_suffix_dedup
from .token_store import op1_token_store

QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_packing": op2_packing,
    "op3_hamming_index": op3_hamming_index,
    "op4_pii": op4_pii,
    "op5_sharding": op5_sharding,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality": op7_quality,
    "op8_near_dup": op8_near_dup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_html_text": op10_html_text,
}

ORACLE_SQL: dict[str, str] = {}
