"""The queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from . import bpe, embeddings, langid, lines, mixing, quality, runs, sharding, simhash, suffixes, toxicity, warc, whitening

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_warc_zip": warc.op2_warc_zip,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_mixing": mixing.op4_mixing,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_simhash": simhash.op7_simhash,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_language_id": langid.op9_language_id,
    "op10_embedding_near_dup": embeddings.op10_embedding_near_dup,
    "op11_whitening": whitening.op11_whitening,
    "op12_line_dedup": lines.op12_line_dedup,
    "op13_periodic_runs": runs.op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op2_warc_zip": warc.ORACLE, "op12_line_dedup": lines.ORACLE}
