"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from stintflow.llm.alignment import op11_alignment
from stintflow.llm.audit import op12_filter_audit
from stintflow.llm.decontaminate import op1_decontaminate
from stintflow.llm.gif import op3_gif
from stintflow.llm.packing import op7_packing
from stintflow.llm.pii import op4_pii
from stintflow.llm.pitman_yor import op9_pitman_yor
from stintflow.llm.quotes import op8_quotes
from stintflow.llm.resample import op6_resample
from stintflow.llm.sharding import op13_shards
from stintflow.llm.simhash import op5_simhash
from stintflow.llm.sql import FILTER_AUDIT, QUOTES, SHARDS, SUBSTRINGS
from stintflow.llm.substrings import op2_substrings
from stintflow.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_substrings": op2_substrings,
    "op3_gif": op3_gif,
    "op4_pii": op4_pii,
    "op5_simhash": op5_simhash,
    "op6_resample": op6_resample,
    "op7_packing": op7_packing,
    "op8_quotes": op8_quotes,
    "op9_pitman_yor": op9_pitman_yor,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_filter_audit": op12_filter_audit,
    "op13_shards": op13_shards,
}

ORACLE_SQL: dict[str, str] = {"op2_substrings": SUBSTRINGS, "op8_quotes": QUOTES, "op12_filter_audit": FILTER_AUDIT, "op13_shards": SHARDS}
