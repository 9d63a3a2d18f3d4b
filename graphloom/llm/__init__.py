"""Training-data operators: deduplication, extraction, filtering, mixing, packing."""
