"""Training-data operators: tokenising, fingerprints, deduplication, filtering and packing."""
