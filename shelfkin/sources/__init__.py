"""Readers, writers and adapters that produce the working tables."""
