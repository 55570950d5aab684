"""Training-data operators: deduplication, quality, tokenising, sharding, scoring, formatting and mixing."""
