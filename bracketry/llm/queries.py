"""Queries of this subpackage and the SQL that some of them have."""

from __future__ import annotations

from .op1 import op1_token_files
from .op2 import SQL as OP2_SQL
from .op2 import op2_decontamination
from .op3 import op3_language_id
from .op4 import op4_lm_score
from .op5 import op5_simhash
from .op6 import op6_token_counts
from .op7 import op7_toxicity
from .op8 import SQL as OP8_SQL
from .op8 import op8_line_dedup
from .op9 import SQL as OP9_SQL
from .op9 import op9_quality
from .op10 import op10_bpe
from .op11 import SQL as OP11_SQL
from .op11 import op11_warc
from .op12 import SQL as OP12_SQL
from .op12 import op12_dialogue_repair
from .op13 import SQL as OP13_SQL
from .op13 import op13_source_audit

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_lm_score": op4_lm_score,
    "op5_simhash": op5_simhash,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
    "op11_warc": op11_warc,
    "op12_dialogue_repair": op12_dialogue_repair,
    "op13_source_audit": op13_source_audit,
}
ORACLE_SQL = {
    "op2_decontamination": OP2_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_quality": OP9_SQL,
    "op11_warc": OP11_SQL,
    "op12_dialogue_repair": OP12_SQL,
    "op13_source_audit": OP13_SQL,
}
