"""Training-data operators (packing, quality, near-duplicates, PII, ...). Nothing outside this package imports it."""
