"""Cleaning, model and ranking operators: DataFrame in, DataFrame out."""
