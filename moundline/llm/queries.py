"""The queries of this package and the SQL that holds them, by name."""

from __future__ import annotations

from moundline.llm import ann, bpe, divergence, embeddings, html, jaccard, lines, mixing, packing, periods, suffixes, toxicity, urls


def queries() -> dict:
    return {
        "op1_url_filter": urls.op1,
        "op2_suffix_dedup": suffixes.op2,
        "op3_nearest": ann.op3,
        "op4_line_dedup": lines.op4,
        "op5_html_extract": html.op5,
        "op6_embedding_dedup": embeddings.op6,
        "op7_jaccard_join": jaccard.op7,
        "op8_toxicity": toxicity.op8,
        "op9_byte_bpe": bpe.op9,
        "op10_mix_sources": mixing.op10,
        "op11_periodic_runs": periods.op11,
        "op12_packing": packing.op12,
        "op13_source_divergence": divergence.op13,
    }


def oracle_sql() -> dict:
    return {
        "op1_url_filter": urls.OP1_SQL,
        "op2_suffix_dedup": suffixes.OP2_SQL,
        "op4_line_dedup": lines.OP4_SQL,
        "op6_embedding_dedup": embeddings.OP6_SQL,
        "op7_jaccard_join": jaccard.OP7_SQL,
        "op10_mix_sources": mixing.OP10_SQL,
        "op11_periodic_runs": periods.OP11_SQL,
        "op13_source_divergence": divergence.OP13_SQL,
    }
