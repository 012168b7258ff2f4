"""Packet sources: delimited text, capture files, Parquet, derived tables, replay."""
