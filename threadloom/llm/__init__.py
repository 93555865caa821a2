"""Operators for preparing training data: tokenizing, scoring, formatting, deduplicating and filtering whole corpora."""
