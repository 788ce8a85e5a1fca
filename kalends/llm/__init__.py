"""Training-data operators: tokens, quality, dedup, redaction, packing, search."""
