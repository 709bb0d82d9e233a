"""Operators for large text corpora: deduplication, extraction, scoring,
tokenisation, archives. Nothing else in the library imports this subpackage."""
