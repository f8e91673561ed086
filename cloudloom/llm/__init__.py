"""Operators for building training data: deduplication, decontamination, language, tokens, scores and filters."""
