"""Operators for preparing text corpora, each in a module of its own; ``queries`` registers them."""
