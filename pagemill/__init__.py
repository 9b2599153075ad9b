"""Spark jobs for document retrieval: cleaning, chunking, vector search, fusion, answer checks, evaluation."""
