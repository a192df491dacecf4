"""Readers and ingestion checks."""
