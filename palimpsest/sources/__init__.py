"""Readers: message tables, plain text, and the memory tables."""
