"""Training-data operators: extraction, fingerprints, deduplication, filtering, encoding and formatting."""
