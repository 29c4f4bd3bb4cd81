"""A fixed dictionary against payloads that arrive."""
