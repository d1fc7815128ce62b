"""The registered queries of this package and their SQL."""

from __future__ import annotations

from . import bpe, codes, fingerprint, html_extract, langid, licenses, lines, mixing, neardup, sharding, topk, toxicity, whitening

QUERIES = {
    f.__name__: f
    for f in (
        topk.op1_maxscore_top_k,
        licenses.op2_license_scan,
        toxicity.op3_toxicity,
        bpe.op4_byte_bpe,
        sharding.op5_jump_sharding,
        neardup.op6_minhash_near_dedup,
        html_extract.op7_html_extraction,
        mixing.op8_mix_sources,
        fingerprint.op9_cws_fingerprints,
        langid.op10_language_id,
        whitening.op11_embedding_whitening,
        codes.op12_vector_codes,
        lines.op13_line_dedup,
    )
}
ORACLES = {
    "op1_maxscore_top_k": topk.OP1_SQL,
    "op2_license_scan": licenses.OP2_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op12_vector_codes": codes.OP12_SQL,
    "op13_line_dedup": lines.OP13_SQL,
}
