"""Structured Streaming ingestion and progress state."""
