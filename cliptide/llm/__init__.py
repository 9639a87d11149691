"""Operators for preparing text at scale: quality, language, near and exact duplicates, tokens."""
