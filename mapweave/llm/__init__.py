"""Operators for training-data pipelines: quality, near duplicates, packing, repeats, contamination, toxicity, secrets,
pseudonyms and web archives. Nothing outside this folder imports it."""
