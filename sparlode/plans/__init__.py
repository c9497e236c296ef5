"""Whole plans: searches, and ingestion with reranking."""
