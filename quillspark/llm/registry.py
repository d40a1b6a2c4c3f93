"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from quillspark.llm import bpe, decontaminate, html_text, jaccard, neighbours, packing, quality, repeats, secrets, token_counts


def queries() -> dict:
    return {
        "op1_neighbours": neighbours.op1_neighbours,
        "op2_html_text": html_text.op2_html_text,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_byte_bpe": bpe.op4_byte_bpe,
        "op5_repeats": repeats.op5_repeats,
        "op6_quality": quality.op6_quality,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_packing": packing.op10_packing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_secret_scan": secrets.op7_sql(),
    }
