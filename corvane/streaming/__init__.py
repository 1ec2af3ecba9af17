"""Structured Streaming forms: windows, dedupe, rate limits, ingestion."""
