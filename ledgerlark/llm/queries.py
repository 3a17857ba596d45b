"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, bpe, fm_quality, host_rules, langid, lm, minhash, mixing, pii, ranked, token_counts, turns, wavelet
from .store import table

QUERIES = {
    "op1_language_id": lambda spark, sf_dir: langid.digest(table(spark, sf_dir, "documents")),
    "op2_source_mixing": lambda spark, sf_dir: mixing.digest(table(spark, sf_dir, "documents")),
    "mixing_totals": lambda spark, sf_dir: mixing.totals(table(spark, sf_dir, "documents")),
    "op3_bpe_transducer": lambda spark, sf_dir: bpe.digest(table(spark, sf_dir, "documents")),
    "op4_lm_scoring": lambda spark, sf_dir: lm.scored(table(spark, sf_dir, "documents")),
    "op5_hilbert_neighbours": lambda spark, sf_dir: ann.neighbours(table(spark, sf_dir, "embeddings")),
    "op6_token_counts": lambda spark, sf_dir: token_counts.digest(table(spark, sf_dir, "documents")),
    "op7_host_quality_rules": lambda spark, sf_dir: host_rules.digest(table(spark, sf_dir, "documents")),
    "op8_near_duplicates": lambda spark, sf_dir: minhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=85, width=3),
    "op9_pii": lambda spark, sf_dir: pii.digest(table(spark, sf_dir, "documents")),
    "op11_turn_reassembly": lambda spark, sf_dir: turns.digest(table(spark, sf_dir, "conversations")),
    "op12_impact_ranked": lambda spark, sf_dir: ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op13_wavelet_shards": lambda spark, sf_dir: wavelet.digest(table(spark, sf_dir, "documents")),
    "op10_fm_quality": lambda spark, sf_dir: fm_quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
}

ORACLE_SQL = {"mixing_totals": mixing.ORACLE, "op7_host_quality_rules": host_rules.ORACLE, "op11_turn_reassembly": turns.ORACLE, "op12_impact_ranked": ranked.ORACLE}
