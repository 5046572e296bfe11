"""Relational operators over messages, pairs, reviews and predictions."""
