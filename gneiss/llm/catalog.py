"""The queries of the training-data operators and their SQL, for the entry module."""

from __future__ import annotations

from .exact_dedup import OP10_SQL, op10_exact_dedup
from .html_extract import op9_html_extraction
from .line_dedup import OP2_SQL, op2_line_dedup
from .packing import op3_packing
from .quality import op5_quality_rules
from .sentencepiece_sample import op1_sentencepiece
from .sharding import OP8_SQL, op8_sharding
from .simhash import op4_simhash
from .substring_dedup import OP7_SQL, op7_substring_dedup
from .warc import OP6_SQL, op6_warc_revisits

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_line_dedup": op2_line_dedup,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_quality_rules": op5_quality_rules,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sharding": op8_sharding,
    "op6_warc_revisits": op6_warc_revisits,
    "op9_html_extraction": op9_html_extraction,
    "op10_exact_dedup": op10_exact_dedup,
}
SQL = {
    "op2_line_dedup": OP2_SQL,
    "op6_warc_revisits": OP6_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op8_sharding": OP8_SQL,
    "op10_exact_dedup": OP10_SQL,
}
