"""Queries of the training-data operators by name, with their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cotraining, fill_middle, hilbert_ann, html_layout, line_dedup, ngram_join, packing, periodic_runs, quality_rules, secret_ledger, sentencepieces, token_records, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": sentencepieces.op1_sentencepiece,
        "op2_html_layout": html_layout.op2_html_layout,
        "op3_token_records": token_records.op3_token_records,
        "op4_harmonic_packing": packing.op4_harmonic_packing,
        "op5_secret_ledger": secret_ledger.op5_secret_ledger,
        "op6_hilbert_neighbours": hilbert_ann.op6_hilbert_neighbours,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_cotraining": cotraining.op9_cotraining,
        "op10_ngram_jaccard": ngram_join.op10_ngram_jaccard,
        "op11_line_dedup": line_dedup.op11_line_dedup,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_fill_middle": fill_middle.op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    """Tokenizers, trained models, sketches and searches with a recall are beyond SQL; tests hold those against brute force."""
    return {
        "op5_secret_ledger": secret_ledger.SQL,
        "op10_ngram_jaccard": ngram_join.SQL,
        "op11_line_dedup": line_dedup.SQL,
        "op12_periodic_runs": periodic_runs.SQL,
        "op13_fill_middle": fill_middle.SQL,
    }
