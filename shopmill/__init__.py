"""Retail order analytics as lazy Spark DataFrame functions."""
