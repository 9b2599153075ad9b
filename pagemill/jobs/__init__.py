"""Whole jobs: build an index, answer questions, evaluate retrieval."""
