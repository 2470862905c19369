"""Whole jobs: extract, preprocess, build, query, evaluate."""
