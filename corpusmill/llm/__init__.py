"""Training-data operators: scoring, filtering, deduplication, mixing, sharding, encoding and packing."""
