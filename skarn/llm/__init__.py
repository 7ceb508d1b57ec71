"""Training-data operators: scoring, scanning, formatting, packing, deduplication and search."""
