"""Operators for building training corpora: quality, toxicity, duplicates, tokens, licences, scores."""
