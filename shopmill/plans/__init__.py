"""Queries, marts, audits and validations over the cleaned and modelled tables."""
