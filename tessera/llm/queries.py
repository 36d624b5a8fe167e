"""The registered queries of this package and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from .ann import OP5_SQL, op5_ann
from .byte_bpe import op11_byte_bpe
from .collocations import OP12_SQL, op12_collocations
from .decontaminate import OP8_SQL, op8_decontamination
from .html_text import op1_html_text
from .kneser_ney import op4_quality_classifier
from .mixing import op10_mixing
from .pii import op7_pii
from .records import op2_token_records
from .simhash_dedup import op9_simhash_dedup
from .substring_dedup import OP6_SQL, op6_substring_dedup
from .warc_store import OP3_SQL, op3_warc_store

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_token_records": op2_token_records,
    "op3_warc_store": op3_warc_store,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_ann": op5_ann,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_pii": op7_pii,
    "op8_decontamination": op8_decontamination,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_mixing": op10_mixing,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_collocations": op12_collocations,
}

ORACLES: dict[str, str] = {
    "op3_warc_store": OP3_SQL,
    "op5_ann": OP5_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op8_decontamination": OP8_SQL,
    "op12_collocations": OP12_SQL,
}
