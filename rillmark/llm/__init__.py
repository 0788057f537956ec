"""Training-data operators: deduplication, scoring, mixing, packing, extraction, archives."""
