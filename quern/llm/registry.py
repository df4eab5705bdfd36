"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import byte_bpe, centroids, divergence, katz, minhash, packing, quality, simhash, token_counts, toxicity, unigram, url_rules, wavelet


def queries():
    return {
        "op1_fingerprints": simhash.query,
        "op2_token_counts": token_counts.query,
        "op3_token_ids": wavelet.query,
        "op4_toxicity": toxicity.query,
        "op5_packing": packing.query,
        "op6_katz": katz.query,
        "op7_unigram": unigram.query,
        "op8_near_duplicates": minhash.query,
        "op9_url_rules": url_rules.query,
        "op10_quality": quality.query,
        "op11_divergence": divergence.query,
        "op12_byte_bpe": byte_bpe.query,
        "op13_centroids": centroids.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    found = {"op8_near_duplicates": minhash.ORACLE, "op9_url_rules": url_rules.ORACLE, "op11_divergence": divergence.ORACLE}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
