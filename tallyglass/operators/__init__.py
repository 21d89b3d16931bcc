"""Transforms of tables: flattening, chunking, quality gates, deduplication, upserts."""
