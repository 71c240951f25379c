"""Training-data operators: sharding, filtering, scoring, search, deduplication, mixing and tokenising."""
