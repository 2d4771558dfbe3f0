"""Training-data operators: mixing, filtering, deduplication, search, tokens."""
