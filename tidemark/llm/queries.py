"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from tidemark.llm.chat import OP7_SQL, op7_chat_formatting
from tidemark.llm.decontam import OP1_SQL, op1_decontamination
from tidemark.llm.html import OP2_SQL, op2_html_extraction
from tidemark.llm.language import op6_language_id
from tidemark.llm.licenses import OP4_SQL, op4_license_scan
from tidemark.llm.lm import op10_lm_scoring
from tidemark.llm.packing import op3_best_fit_packing
from tidemark.llm.privacy import op12_pii
from tidemark.llm.resample import OP13_SQL, op13_importance_resampling
from tidemark.llm.search import OP11_SQL, op11_ranked_search
from tidemark.llm.simhash import op8_simhash_dedup
from tidemark.llm.tokencount import op9_token_counts
from tidemark.llm.topk import OP5_SQL, op5_exact_topk

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_html_extraction": op2_html_extraction,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_license_scan": op4_license_scan,
    "op5_exact_topk": op5_exact_topk,
    "op6_language_id": op6_language_id,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_ranked_search": op11_ranked_search,
    "op12_pii": op12_pii,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES = {
    "op1_decontamination": OP1_SQL,
    "op2_html_extraction": OP2_SQL,
    "op4_license_scan": OP4_SQL,
    "op5_exact_topk": OP5_SQL,
    "op7_chat_formatting": OP7_SQL,
    "op11_ranked_search": OP11_SQL,
    "op13_importance_resampling": OP13_SQL,
}
