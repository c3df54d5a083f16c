"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from . import bpe, langid, linefreq, mixing, paritysketch, phrases, rankbpe, recompress, scann, schemadrift, sharding, tokencount, warc


def queries() -> dict:
    return {
        "op1_warc_transactions": warc.op1_warc_transactions,
        "op2_line_frequency": linefreq.op2_line_frequency,
        "op3_anisotropic_search": scann.op3_anisotropic_search,
        "op4_recompression": recompress.op4_recompression,
        "op5_token_counts": tokencount.op5_token_counts,
        "op6_external_shuffle": sharding.op6_external_shuffle,
        "op7_raked_mixture": mixing.op7_raked_mixture,
        "op8_parity_sketch_join": paritysketch.op8_parity_sketch_join,
        "op9_language_profiles": langid.op9_language_profiles,
        "op10_byte_bpe": bpe.op10_byte_bpe,
        "op11_rank_array_bpe": rankbpe.op11_rank_array_bpe,
        "op12_phrases": phrases.op12_phrases,
        "op13_schema_rewrite": schemadrift.op13_schema_rewrite,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_transactions": warc.OP1_SQL, "op2_line_frequency": linefreq.OP2_SQL, "op4_recompression": recompress.OP4_SQL, "op8_parity_sketch_join": paritysketch.OP8_SQL, "op12_phrases": phrases.OP12_SQL}
