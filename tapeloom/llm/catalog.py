"""Queries of this subpackage, by name."""

from __future__ import annotations

from tapeloom.llm.collocations import OP11_SQL, op11_phrase_collocations
from tapeloom.llm.consistent_parse import op13_document_fingerprints
from tapeloom.llm.contamination import op2_decontamination
from tapeloom.llm.language_id import op10_language_id
from tapeloom.llm.language_model import op6_hmm_scoring
from tapeloom.llm.line_dedup import OP4_SQL, op4_line_dedup
from tapeloom.llm.manifest import OP12_SQL, op12_merkle_manifest
from tapeloom.llm.packing import op1_best_fit_packing
from tapeloom.llm.quality import op8_quality_classifier
from tapeloom.llm.simhash import op5_simhash_near_dedup
from tapeloom.llm.token_counts import op3_token_counts
from tapeloom.llm.token_files import op7_token_files
from tapeloom.llm.topk_search import OP9_SQL, op9_exact_topk


def queries():
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_decontamination": op2_decontamination,
        "op3_token_counts": op3_token_counts,
        "op4_line_dedup": op4_line_dedup,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_hmm_scoring": op6_hmm_scoring,
        "op7_token_files": op7_token_files,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_exact_topk": op9_exact_topk,
        "op10_language_id": op10_language_id,
        "op11_phrase_collocations": op11_phrase_collocations,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_document_fingerprints": op13_document_fingerprints,
    }


def oracle_sql():
    return {"op4_line_dedup": OP4_SQL, "op9_exact_topk": OP9_SQL, "op11_phrase_collocations": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
