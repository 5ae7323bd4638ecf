"""Operators for large text corpora: deduplication, scanning, classification, tokenising."""
