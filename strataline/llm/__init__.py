"""Operators of a training-data pipeline: quality, fingerprints, deduplication, mixing, decontamination, PII, language, tokens."""
