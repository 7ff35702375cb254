"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op3_byte_level_bpe
from .chat import OP7_SQL, op7_chat_formatting
from .fim import OP11_SQL, op11_fill_in_middle
from .html_text import OP1_SQL, op1_html_extraction
from .knn import OP5_SQL, op5_exact_top_k
from .media import op9_media_columns
from .packing import op4_best_fit_packing
from .quality import op6_quality_classifier
from .sharding import op10_hilbert_sharding
from .simhash import op8_simhash_near_dedup
from .suffix_dedup import op2_suffix_dedup
from .url_filter import op12_url_filter
from .vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_byte_level_bpe": op3_byte_level_bpe,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_media_columns": op9_media_columns,
    "op10_hilbert_sharding": op10_hilbert_sharding,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_url_filter": op12_url_filter,
    "op13_vector_codes": op13_vector_codes,
}

SQL: dict[str, str] = {"op1_html_extraction": OP1_SQL, "op5_exact_top_k": OP5_SQL, "op7_chat_formatting": OP7_SQL, "op11_fill_in_middle": OP11_SQL, "op13_vector_codes": OP13_SQL}
