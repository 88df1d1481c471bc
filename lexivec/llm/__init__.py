"""Operators for large-scale training-data pipelines (fingerprints, token
counts, BPE, mixing, near-duplicates, extraction, quality, chat formatting).

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
