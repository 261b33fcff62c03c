"""Readers, writers and the adapter for the sample tables."""
