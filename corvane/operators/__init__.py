"""Operators on DataFrames: indexing, retrieval, ingestion, evidence, metrics, registries."""
