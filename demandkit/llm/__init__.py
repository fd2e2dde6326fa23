"""Training-data operators: filtering, deduplication, sharding, formatting, packing."""
