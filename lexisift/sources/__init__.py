"""Readers, writers and generators of texts, dictionaries and reports."""
