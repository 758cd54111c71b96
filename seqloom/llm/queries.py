"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .bpe import op4_byte_bpe
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .html_extract import op9_html_extraction
from .langid import op3_language_id
from .line_dedup import op7_line_dedup
from .mixing import OP10_SQL, op10_mixing
from .ngram_join import OP8_SQL, op8_ngram_jaccard
from .quality import op5_quality_rules
from .toxicity import op2_toxicity
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_html_extraction": op9_html_extraction,
    "op10_mixing": op10_mixing,
}

ORACLES = {
    "op1_warc": OP1_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op8_ngram_jaccard": OP8_SQL,
    "op10_mixing": OP10_SQL,
}
