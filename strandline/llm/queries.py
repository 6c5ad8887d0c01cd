"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from strandline.llm import audit, decontaminate, embeddings, licences, near_text, negatives, neighbours, packing, pii, quality, repeats, tokens, urls


def queries() -> dict:
    return {
        "op1_embeddings": embeddings.op1_embeddings,
        "op2_repeats": repeats.op2_repeats,
        "op3_quality": quality.op3_quality,
        "op4_packing": packing.op4_packing,
        "op5_pii": pii.op5_pii,
        "op6_token_counts": tokens.op6_token_counts,
        "op7_url_filter": urls.op7_url_filter,
        "op8_licences": licences.op8_licences,
        "op9_near_text": near_text.op9_near_text,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_neighbours": neighbours.op11_neighbours,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_filter_audit": audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embeddings": embeddings.SQL1,
        "op2_repeats": repeats.SQL2,
        "op5_pii": pii.sql5(),
        "op7_url_filter": urls.sql7(),
        "op8_licences": licences.sql8(),
        "op10_decontaminate": decontaminate.SQL10,
        "op12_hard_negatives": negatives.SQL12,
        "op13_filter_audit": audit.SQL13,
    }
